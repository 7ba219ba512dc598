"""Secret scanning with a random forest that removes false positives.

A generous pattern finds candidates: runs of 16 or more key characters within a
word of the text, any 8 or more characters that are assigned to a key word, and
the lines of private keys. Each is described by its length, character
transitions, dictionary coverage, path form, provider prefix and the words
around, and a random forest
trained on labelled findings tells secrets from digests, paths, addresses and
names. Built-in functions and Spark's own forest only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.text import sealed
from gradeframe.llm.shared import written

SEPARATORS = "[\\x20\\x09-\\x0D]+"
CANDIDATE = "[A-Za-z0-9_+/.~-]{16,}={0,2}"
#: Words near a credential, and words near a value that only looks like one.
KEY_WORDS = "(?i)(token|secret|passw|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth(?!or(?!i[sz]))|bearer|credential|client[_-]?secret)"
OTHER_WORDS = "(?i)(commit|sha1|sha256|sha512|checksum|digest|md5|etag|uuid|guid|revision|integrity|version|example|sample|placeholder|build)"
#: Values that stand in an assignment to a key word: quoted, or up to the next quote, comma, semicolon or parameter.
ASSIGNED = KEY_WORDS + "[A-Za-z0-9_]*[^A-Za-z0-9=:]*(?:=>|:=|==?|:)[(\\[{]*(\"[^\"]{8,}|'[^']{8,}|`[^`]{8,}|(?:[^\"'`,;&]|&(?![A-Za-z0-9_]+=)){8,})"
#: Punctuation and repeated signs after a value without quotes.
TRAILING = "(?:([#%$&*!|])\\1+|[,;.:)\\]}>])+$"
#: Words to the left and to the right among which a key word still speaks for a value.
AROUND = 8
#: Forms of providers, which need no key word.
KNOWN = "(^|[^A-Za-z0-9])((AKIA|ASIA)[A-Z0-9]{12,}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(live|test)_[A-Za-z0-9]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}|SG\\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|ya29\\.[A-Za-z0-9_-]{20,})"
#: Bodies of private keys.
PEM = "(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\\z)"
PEM_LINE = "[A-Za-z0-9+/]{8,}={0,2}"
#: Technical words that a dictionary of running text lacks.
TECHNICAL = ["example", "sample", "http", "https", "mail", "test", "your", "here", "token", "secret", "password", "placeholder", "changeme", "user", "home", "index", "html", "config", "local", "value", "name", "path", "file", "image", "static", "assets", "download", "version", "default"]
#: Words that fill templates whatever the corpus holds; every second one is a dictionary word, as in a corpus.
FIXED = ["river", "window", "garden", "paper", "station", "morning", "letter", "bridge", "summer", "kitchen", "doctor", "market", "winter", "forest", "picture", "teacher", "village", "number", "music", "island", "machine", "library", "question", "weather", "silver", "mountain", "history", "engine", "harbour", "country", "people", "science"]
#: Rows of templates that are filled with them.
FIXED_ROWS = 200
#: Share of all characters of the corpus, in occurrences, that makes a word a dictionary word; two occurrences at least.
FREQUENT = 1e-6
#: A candidate is a secret from this share of votes on.
THRESHOLD = 0.5
REDACTED = "[SECRET]"
#: Documents whose words and numbers fill the templates of derived labelled findings, about; chosen by a hash.
TRAINING_ROWS = 1500
#: Words of a document that fill templates.
SURROUNDING = 12

FEATURES = ["n_chars", "n_digits", "n_upper", "n_lower", "n_vowels", "n_distinct", "transitions", "longest_run", "covered", "n_slashes", "n_dots", "n_dashes", "hex_only", "padded", "suffix_form", "near_key", "near_other", "assigned", "quoted", "address", "far_key", "known_form", "in_key", "n_other"]
CONTEXT = ["value", "prefix", "suffix", "before2", "before", "after"]
#: Context that labelled findings may lack: key words farther away, and "key" within a private key.
FARTHER = ["around", "block"]


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, CONTEXT, FARTHER): candidates of every text, with the words around.

    ``row`` is a hash of doc_id and text, so it also names rows with null ids;
    repeated rows give repeated candidates. Null and empty texts have none.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    bodies = F.when(F.col("text").contains("PRIVATE KEY"), F.regexp_extract_all("text", F.lit(PEM), F.lit(1))).otherwise(F.array().cast("array<string>"))
    words = sealed(docs.where("text is not null").select(row, "doc_id", "text"), _w=F.array_remove(F.split("text", SEPARATORS), ""), _pem=bodies, _named=F.col("text").rlike(KEY_WORDS)).drop("text")
    w, pem = F.col("_w"), F.col("_pem")
    long = F.transform(w, lambda x, i: F.when(((F.length(x) >= 16) & x.rlike(CANDIDATE)) | ((F.size(pem) > 0) & (F.length(x) >= 8)), i))
    # A value assigned to a key word stands in the key word's own word or in one of the next two.
    named = F.when(F.col("_named"), F.flatten(F.transform(w, lambda x, i: F.when(x.rlike(KEY_WORDS), F.array(i, i + 1, i + 2)).otherwise(F.array().cast("array<int>"))))).otherwise(F.array().cast("array<int>"))
    at = F.filter(F.array_distinct(F.concat(long, named)), lambda i: i.isNotNull() & (i < F.size(w)))
    places = words.select("row", "doc_id", "_w", "_pem", "_named", F.explode(at).alias("place"))
    p = F.col("place")
    first = F.greatest(p - AROUND, F.lit(0))
    farther = F.concat(F.slice(w, first + 1, F.greatest(p - 2, F.lit(0)) - first), F.slice(w, p + 3, F.lit(AROUND - 1)))
    around = F.when(F.col("_named"), F.regexp_extract(F.concat_ws(" ", farther), KEY_WORDS, 0)).otherwise("")
    near = places.select("row", "doc_id", "place", "_pem", around.alias("around"), F.get(w, p).alias("word"), *[F.coalesce(F.get(w, p + d), F.lit("")).alias(n) for n, d in (("before2", -2), ("before", -1), ("after", 1))])
    word, before = F.col("word"), F.col("before")
    sign = "[^A-Za-z0-9]*[=:][^A-Za-z0-9]*$"
    key = KEY_WORDS + "[A-Za-z0-9_]*"
    told = before.rlike(key + sign) | (before.rlike("^" + sign) & F.col("before2").rlike(key + "[^A-Za-z0-9]*$")) | (before.rlike(key + "[^A-Za-z0-9]*$") & word.rlike("^[=:]"))
    spoken = F.when(told, F.concat(F.lit("token="), F.regexp_replace("word", "^[=:>]+", ""))).otherwise(word)
    quoted = F.transform(F.regexp_extract_all(spoken, F.lit(ASSIGNED), F.lit(2)), lambda x: F.when(x.rlike("^[\"'`]"), F.substring(x, 2, 1 << 30)).otherwise(F.regexp_replace(x, TRAILING, "")))
    lines = F.when(F.size("_pem") > 0, F.filter(F.regexp_extract_all("word", F.lit(PEM_LINE), F.lit(0)), lambda x: F.exists("_pem", lambda b: b.contains(x)))).otherwise(F.array().cast("array<string>"))
    found = sealed(near, _runs=F.when(F.length("word") >= 16, F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")), _more=F.filter(F.array_union(quoted, lines), lambda x: F.length(x) >= 8))
    each = found.select("row", "doc_id", "place", "_pem", "word", "around", "before2", "before", "after", F.explode(F.concat("_runs", F.array_except("_more", "_runs"))).alias("value"))
    start = F.instr("word", F.col("value"))
    return each.withColumns({
        "prefix": F.substring("word", F.lit(1), start - 1), "suffix": F.substring("word", start + F.length("value"), F.lit(40)),
        "block": F.when(F.exists("_pem", lambda b: b.contains(F.col("value"))), "key").otherwise(""),
    }).drop("word", "_pem")


def dictionary(docs: DataFrame, frequent: float = FREQUENT) -> DataFrame:
    """(part): lower-cased letter words of 3 to 12 letters with ``frequent`` occurrences, or more, per character of all texts, and technical words."""
    least = max(2, math.ceil(frequent * (docs.agg(F.sum(F.length("text"))).first()[0] or 0)))
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("part")).where("length(part) between 3 and 12")
    often = words.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("part")
    fixed = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in TECHNICAL + FIXED[::2]])).alias("part"))
    return often.union(fixed).distinct()


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with CONTEXT and FARTHER columns (none null) plus the columns FEATURES.

    Coverage is the share of characters in parts (letter runs, cut before
    capitals) that ``words`` (part) lists; the join goes by distinct part.
    """
    v, left, right = F.col("value"), F.concat_ws(" ", "before2", "before", "prefix"), F.concat_ws(" ", "suffix", "after")
    size = F.length(v)
    kinds = F.translate(F.translate(F.translate(v, "abcdefghijklmnopqrstuvwxyz", "a" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "0123456789", "0" * 10)
    runs = F.regexp_replace(kinds, "(.)\\1+", "$1")

    def share(chars: str) -> Column:
        return (size - F.length(F.translate(v, chars, ""))) / size

    rows = found.withColumns({
        "n_chars": size.cast("double"), "n_digits": share("0123456789"), "n_upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_lower": share("abcdefghijklmnopqrstuvwxyz"),
        "n_vowels": share("aeiouAEIOU"), "n_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(40)),
        "transitions": (F.length(runs) - 1) / size, "longest_run": F.array_max(F.transform(F.regexp_extract_all(kinds, F.lit("a+|A+|0+|[^aA0]+"), F.lit(0)), F.length)) / size,
        "n_slashes": share("/"), "n_dots": share("."), "n_dashes": share("-_"),
        "hex_only": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "padded": v.endswith("=").cast("double"),
        "suffix_form": v.rlike("\\.[a-z]{2,5}$").cast("double"),
        "near_key": (left.rlike(KEY_WORDS) | right.rlike(KEY_WORDS)).cast("double"), "near_other": (left.rlike(OTHER_WORDS) | v.rlike(OTHER_WORDS)).cast("double"),
        "assigned": F.concat_ws(" ", "before", "prefix").rlike("[=:]").cast("double"), "quoted": (F.col("prefix").rlike("[\"'`]$") & F.col("suffix").rlike("^[\"'`]")).cast("double"),
        "address": (F.col("prefix").contains("@") | F.col("prefix").contains("://") | v.contains("://")).cast("double"),
        "far_key": F.col("around").rlike(KEY_WORDS).cast("double"), "known_form": v.rlike(KNOWN).cast("double"), "in_key": (F.col("block") == "key").cast("double"),
        "n_other": F.length(F.regexp_replace(v, "[A-Za-z0-9_+/.~=-]", "")) / size,
        "_parts": F.filter(F.transform(F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower), lambda x: F.length(x) >= 3),
    })
    keyed = rows.withColumn("_key", F.xxhash64("value"))
    pieces = keyed.select("_key", F.explode(F.array_distinct("_parts")).alias("part")).distinct().join(words, "part").groupBy("_key").agg(F.collect_set("part").alias("_known"))
    joined = keyed.join(pieces, "_key", "left")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    covered = F.aggregate(F.transform("_parts", lambda x: F.when(F.array_contains(known, x), F.length(x)).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return joined.withColumn("covered", covered / size).drop("_key", "_parts", "_known")


def derived_findings(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings (CONTEXT, FARTHER, label) in the surroundings of real texts.

    Templates put digests of the documents' ids, as hex, base64 and mixed
    tokens, and passwords made of words, digits and signs beside credential
    words, digests in the forms of providers and lines of private keys beside
    any words (label 1), and the same digests beside other words, identifiers,
    addresses, paths, glued words, ids and placeholders (label 0). About ``rows`` documents, chosen by a hash, supply
    words; that bound is what the forest is fitted on. FIXED_ROWS rows of fixed
    words join them, so that any corpus gives findings of both labels.
    """
    total = docs.agg(F.count("text")).first()[0]
    # The words are chosen by hashes from the whole text, and cut to a few before any row is moved.
    letters = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,20}"), F.lit(0)))
    few = F.slice(F.array_sort(F.transform(letters, lambda x: F.struct(F.xxhash64(x, "doc_id").alias("h"), x.alias("x")))), 1, SURROUNDING)
    chosen = docs.where(F.col("text").isNotNull() & (F.xxhash64("doc_id", "text") / 2.0**64 + 0.5 < rows / max(total, 1)))
    base = chosen.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.transform(few, lambda x: x["x"]).alias("w")).where(F.size("w") == SURROUNDING)
    drawn = F.transform(F.array_sort(F.transform(F.array(*[F.lit(t) for t in FIXED]), lambda x: F.struct(F.xxhash64(x, "doc_id").alias("h"), x.alias("x")))), lambda x: x["x"])
    base = base.union(docs.sparkSession.range(FIXED_ROWS).select((-1 - F.col("id")).alias("doc_id")).select("doc_id", drawn.alias("w")))
    base = base.withColumns({f"sha{i}": F.sha2(F.concat(F.lit(f"finding {i} "), F.col("doc_id").cast("string")), 256) for i in range(4)})
    base = written(base.withColumns({f"b64{i}": F.translate(F.base64(F.unhex(f"sha{i}")), "\r\n", "") for i in range(4)}), "surroundings")
    words, sha, b64 = F.col("w"), [F.col(f"sha{i}") for i in range(4)], [F.col(f"b64{i}") for i in range(4)]
    url64 = F.regexp_replace(F.translate(b64[1], "+/", "-_"), "=", "")
    uuid = F.concat_ws("-", F.substring(sha[2], 1, 8), F.substring(sha[2], 9, 4), F.substring(sha[2], 13, 4), F.substring(sha[2], 17, 4), F.substring(sha[2], 21, 12))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(6))

    def one(names: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(pick, F.lit(len(names))) + 1).cast("int"))

    def finding(label: int, value: Column, prefix: Column | str = "", suffix: Column | str = "", before2: Column | str = None, before: Column | str = None, after: Column | str = None, around: Column | str = "", block: str = "") -> Column:
        parts = {"value": value, "prefix": prefix, "suffix": suffix, "before2": words[0] if before2 is None else before2, "before": words[1] if before is None else before, "after": words[2] if after is None else after, "around": around, "block": block}
        return F.struct(*[(p if isinstance(p, Column) else F.lit(p)).alias(n) for n, p in parts.items()], F.lit(float(label)).alias("label"))

    keys = one(["token", "secret", "api_key", "password", "access_key", "client_secret"])
    upper = F.upper(keys)
    others = one(["commit", "sha256", "checksum", "digest", "etag", "revision"])
    hexes = F.substring(sha[0], F.lit(1), F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (F.pmod(pick, F.lit(3)) + 1).cast("int")))
    short64 = F.substring(b64[0], F.lit(1), F.lit(20) + (pick * 4).cast("int"))
    glued = F.concat_ws("", F.slice(words, 3, 5))
    mixed = F.regexp_replace(b64[3], "[+/=]", "")
    aws = F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16)))
    jwt = F.concat(F.lit("eyJ"), F.substring(mixed, 4, 17), F.lit(".eyJ"), F.substring(url64, 4, 30), F.lit("."), F.substring(url64, 1, 43))
    forms = [aws, jwt, *[F.concat(F.lit(a), F.substring(mixed, i, n)) for a, i, n in (("ghp_", 1, 36), ("sk_live_", 3, 24), ("glpat-", 2, 20), ("xoxb-", 5, 24), ("AIza", 1, 35))]]
    line, other_line = F.substring(F.concat(b64[0], b64[1]), 3, 64), F.substring(F.concat(b64[2], b64[3]), 1, 64)
    digits = F.translate(F.substring(sha[1], 1, 4), "abcdef", "123456")
    mark = one(["!", "&", "@", "$", "%", ":"])
    stem = F.substring(F.concat(words[3], words[4], words[5]), F.lit(1), F.lit(5) + pick.cast("int"))
    leet = F.concat(F.initcap(F.translate(stem, "aeo", "430")), mark, F.substring(digits, F.lit(1), F.lit(2) + F.pmod(pick, F.lit(2)).cast("int")), F.substring(mixed, 1, 2))
    wide = F.concat(F.substring(mixed, 1, 4), mark, F.substring(mixed, F.lit(7), F.lit(3) + (pick * 3).cast("int")))
    stemmed = F.concat(stem, digits)
    letters = F.lower(F.substring(F.concat(words[3], words[4], words[5], words[6]), F.lit(1), F.lit(8) + pick.cast("int")))
    card = F.translate(F.substring(sha[1], 9, 16), "abcdef", "123456")
    mail = F.concat(F.lit("mail"), pick.cast("string"), F.lit(".example.com"))
    assigned = F.concat(keys, F.lit("="))
    unset = ["********", "${PASSWORD}", "${API_KEY}", "<password>", "<your-token>", "{{secret}}", "os.environ[", "os.getenv(", "process.env.TOKEN", "getpass.getpass()", "config.password", "args.token", "get_token(user)", "self.token", "settings.SECRET_KEY", "required|string", "undefined", "changeme", "password", "None,None", REDACTED, "https://www.example.com/reset"]
    findings = [
        *[finding(1, f) for f in forms], *[finding(1, f, "", ".", words[0], others) for f in forms[:4]], *[finding(1, f, '"', '",') for f in forms[2:]],
        finding(1, line, "", "", other_line, other_line, other_line, block="key"), finding(1, line, "", "", "PRIVATE", "KEY-----", other_line, block="key"), finding(1, F.substring(b64[0], 30, 15), "", "", other_line, other_line, "-----END", block="key"),
        finding(1, hexes, after=keys), finding(1, url64, after=keys), finding(1, short64, '"', F.concat(F.lit('"('), keys, F.lit(")"))), finding(1, mixed, "", "", after=F.concat(F.lit("("), keys, F.lit(")"))),
        finding(1, hexes, around=keys), finding(1, url64, around=keys), finding(1, short64, '"', '"', around=keys), finding(1, mixed, "", ".", around=keys),
        *[finding(1, f, '"', '"', keys, "=") for f in (leet, wide, stemmed, uuid)], *[finding(1, f, "", "", words[1], F.concat(keys, F.lit(":"))) for f in (leet, wide, stemmed)],
        *[finding(1, f, F.concat(keys, F.lit(q)), r) for f in (leet, wide) for q, r in (("=", ""), ('="', '"'), ('":"', '",'))],
        finding(0, line, "", "", other_line, other_line, other_line), finding(0, line, "", "", "-----BEGIN", "CERTIFICATE-----", other_line), *[finding(0, f) for f in (line, url64, mixed, short64)],
        finding(0, card), finding(0, card, around=keys), finding(0, hexes, "", "", words[0], others, around=keys), finding(0, glued, around=keys), finding(0, glued, after=keys),
        finding(0, F.concat_ws("_", F.slice(words, 3, 5)), around=keys), finding(0, F.concat_ws("-", F.slice(words, 3, 5)), after=keys), finding(0, mail, F.concat(words[3], F.lit(".12@")), around=keys), finding(0, mail, F.lit("12@"), after=keys),
        finding(0, F.concat(F.lit("/home/user/"), F.concat_ws("/", F.slice(words, 4, 4)), F.lit(".txt")), around=keys), finding(0, F.concat(F.lit("www.example.com/"), F.concat_ws("/", words[3], words[4]), F.lit(".html")), "https://", around=keys),
        finding(0, letters, "", "", words[1], F.concat(keys, F.lit(":"))), finding(0, letters, "", ",", keys, "="), finding(0, F.initcap(letters), "", ".", words[1], F.concat(keys, F.lit(":"))), finding(0, letters, assigned, ""), finding(0, letters, '"', '"', keys, ":"),
        finding(0, F.concat_ws("_", words[3], words[4]), "", "", keys, "="), finding(0, F.concat_ws(".", words[3], words[4], keys), assigned, ""), finding(0, F.concat(words[3], F.lit("("), words[4], F.lit(")")), "", "", keys, "="), finding(0, F.concat(F.lit("ghp_"), F.repeat(F.lit("x"), 36)), '"', '"', keys, "="), finding(0, F.concat(F.lit("sk_live_"), F.repeat(F.lit("x"), 24))),
        *[finding(0, F.lit(x), '"' if i % 2 else "", '"' if i % 2 else "", keys, "=") for i, x in enumerate(unset)], *[finding(0, F.lit(x), assigned, "") for x in unset],
        finding(1, hexes, '"', '"', keys, "="), finding(1, F.upper(hexes), '"', F.lit('"!!'), F.concat(upper, F.lit("!!")), "="), finding(1, short64, "'", "'", keys, ":"),
        finding(1, url64, F.concat(keys, F.lit("=")), ""), finding(1, F.concat(F.lit("ghp_"), F.substring(url64, 1, 36)), F.concat(keys, F.lit(':"')), '"'), finding(1, b64[3], "", ";", F.concat(upper, F.lit(":")), "Bearer"),
        finding(1, F.concat(F.lit("AKIA"), F.upper(F.substring(sha[3], 1, 16))), '"', '"', keys, "="), finding(1, F.concat(F.lit("sk_live_"), F.substring(url64, 3, 24)), F.concat(keys, F.lit('="')), '",'),
        finding(1, hexes, '"', F.lit('"%%%'), F.concat(keys, F.lit("###")), F.lit("=&&&")), finding(1, hexes, '"', '"', "|", F.concat(keys, F.lit("="))),
        finding(0, hexes, "", "", words[0], others), finding(0, hexes, F.concat(others, F.lit(":")), ""), finding(0, F.substring(b64[2], 1, 43), F.concat(others, F.lit("-")), '"', words[0], F.lit("integrity=")),
        finding(0, hexes), finding(0, uuid, '"', '"', "id", "="), finding(0, uuid), finding(0, glued), finding(0, glued, "", F.lit("%%%")), finding(0, F.lower(glued), '"', '"', keys, "="),
        finding(0, F.concat(F.lit("mail"), pick.cast("string"), F.lit(".example.com")), F.concat(words[3], F.lit(".12@"))), finding(0, F.concat(F.lit("mail"), pick.cast("string"), F.lit(".example.com")), F.concat(F.lit("12@"))),
        finding(0, F.concat(F.lit("www.example.com/"), F.concat_ws("/", words[3], words[4]), F.lit(".html")), "https://"), finding(0, F.concat(F.lit("/home/user/"), F.concat_ws("/", F.slice(words, 4, 4)), F.lit(".txt"))),
        finding(0, F.concat(F.lit("src/"), F.concat_ws("/", F.slice(words, 4, 4)), F.lit(".py")), "", ",", "in", "file"), finding(0, F.concat_ws("_", F.slice(words, 3, 5))), finding(0, F.concat_ws("-", F.slice(words, 4, 5)), "", "."),
        finding(0, F.lit("your_token_value_here"), '"', '"', keys, "="), finding(0, F.lit("xxxxxxxxxxxxxxxxxxxxxxxx"), '"', '"', keys, "="), finding(0, F.repeat(F.lit("0"), 32), '"', '"', keys, "="),
        finding(0, F.concat(F.lit("example_"), keys, F.lit("_placeholder")), '"', '"', keys, "="), finding(0, F.lit("--------------------")), finding(0, F.lit("....................")), finding(0, F.lit("____________________")),
        finding(0, F.concat(F.lit("2024-01-02T03-04-0"), pick.cast("string"), F.lit(".000Z"))), finding(0, F.concat(F.lit("v1.2.3-build."), F.substring(sha[1], 1, 8)), "", "", words[0], "version"),
    ]
    # Few templates in a step: the code of all together is too long to be compiled.
    parts = [base.select(F.explode(F.array(*findings[i : i + 16])).alias("f")).select("f.*") for i in range(0, len(findings), 16)]
    return reduce(DataFrame.union, parts).where("length(value) >= 16 or length(value) >= 8 and (concat_ws(' ', before, prefix) rlike '[=:]' or block > '')").fillna("")


def train(findings: DataFrame, words: DataFrame, trees: int = 30, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (CONTEXT, FARTHER, label 0 or 1)."""
    rows = written(described(findings, words).fillna(0.0, FEATURES).select(*FEATURES, "label"), "findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, place, value, probability, is_secret): every candidate in ``docs`` (doc_id, text) with its verdict.

    ``findings`` are labelled findings to learn from (CONTEXT, label, and
    FARTHER if known); without them they are derived from the texts. ``place`` is the word's place in the text. Null and
    empty texts have no candidates; labelled findings of fewer than two classes
    are joined by the derived ones.
    """
    words = written(dictionary(docs), "dictionary")
    given = derived_findings(docs) if findings is None else findings
    labelled = written(given.withColumns({c: F.lit("") for c in FARTHER if c not in given.columns}).select(*CONTEXT, *FARTHER, "label"), "labelled")
    found = candidates(docs)
    if findings is not None and labelled.select("label").distinct().count() < 2:
        labelled = labelled.union(derived_findings(docs).select(labelled.columns))
    model = train(labelled, words)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(found, words).fillna(0.0, FEATURES))
    scored = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("row", "doc_id", "place", "value", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the same columns; each secret of ``found``, the longest first, replaced by ``REDACTED`` throughout its text, n_chars to match."""
    secrets = found.where("is_secret").groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).getField("value").alias("_values"))
    secrets = secrets.withColumnRenamed("row", "_row")
    joined = docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(secrets, "_row", "left")
    text = F.when(F.col("_values").isNull(), F.col("text")).otherwise(F.aggregate("_values", F.col("text"), lambda t, v: F.replace(t, v, F.lit(REDACTED))))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_values").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
