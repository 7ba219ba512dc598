"""The same shapes as SQL common table expressions, and SQL building blocks."""

from __future__ import annotations

ITEMS = """items AS (SELECT doc_id AS item_id, lang AS task,
  CASE WHEN n_chars<600 THEN 'easy' WHEN n_chars<2500 THEN 'medium' ELSE 'hard' END AS difficulty,
  source, n_chars, text FROM documents)"""

EVAL = ITEMS + """, eval_long AS (SELECT item_id, 'm'||m AS model, task, difficulty, n_chars, text,
  CASE WHEN (item_id*7919 + m*104729 + n_chars*31) % 1000 < 900-60*m THEN 1 ELSE 0 END AS correct,
  CASE WHEN (item_id+m) % 37 = 0 THEN 'FAIL: timeout' WHEN (item_id+m) % 5 < 2 THEN 'Yes, it does'
       WHEN (item_id+m) % 5 < 4 THEN 'no' ELSE 'unknown' END AS prediction
  FROM items CROSS JOIN (SELECT unnest(range(0,6)) AS m) r)"""

VALID = EVAL + ", valid AS (SELECT * FROM eval_long WHERE prediction NOT LIKE '%FAIL%')"

RATINGS = """ratings AS (SELECT doc_id AS item_id, lang AS task, rater,
  CASE WHEN rater = 0 OR (doc_id*31 + rater*17) % 10 < 8 THEN quality ELSE 1-quality END AS label
  FROM labels JOIN documents USING (doc_id) CROSS JOIN (SELECT unnest(range(0,3)) AS rater) r)"""

PAIRS = """docw AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\p{Z}]+'), lambda w: w <> '') AS w FROM documents),
pieces AS (SELECT doc_id, st//12 AS pos, w[st+1:st+12] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), 12)) AS st FROM docw)),
docx AS (SELECT a.doc_id*1000000+a.pos AS i, a.w, array_to_string(a.w,' ') AS f, coalesce(b.w, []) AS ow,
   (a.doc_id*1000000+a.pos) % 12 AS kind, ((a.doc_id*1000000+a.pos) // 12) % 2 AS half
  FROM pieces a LEFT JOIN pieces b ON b.doc_id = (a.doc_id*13+7) % (SELECT count(*) FROM documents) AND b.pos = a.pos),
answer_pairs AS (SELECT i AS item_id, 'm'||((i//7)%4) AS model,
  CASE WHEN kind IN (4,5) THEN 'contradiction_detection' WHEN kind IN (6,7) THEN 'numerical_reasoning'
    WHEN kind<3 THEN 'regulatory_interpretation' ELSE 'temporal_reasoning' END AS task,
  CASE WHEN kind IN (4,5) THEN 'Yes, '||f WHEN kind IN (6,7) THEN f||' '||(i%500)||' crore' ELSE f END AS reference,
  CASE WHEN kind<2 THEN translate(f,'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ')||' !'
    WHEN kind=2 THEN array_to_string(list_reverse(w),' ')
    WHEN kind=3 THEN array_to_string(list_filter(w, lambda x, k: (k-1)%4 <> 3),' ')
    WHEN kind=4 THEN 'yes '||array_to_string(w[1:6],' ')
    WHEN kind=5 THEN 'No, '||f
    WHEN kind IN (6,7) THEN 'about '||(i%500+half)||' units in total'
    WHEN kind=8 THEN array_to_string(ow,' ')
    WHEN kind=9 THEN array_to_string(list_concat(w[1:9], ow[1:3]),' ')
    WHEN kind=10 THEN f||' indeed'
    WHEN (i//12)%3=0 THEN 'FAIL: timeout' WHEN (i//12)%3=1 THEN f||', or it cannot be determined' ELSE '' END AS prediction
  FROM docx)"""

REG = """reg_text AS (SELECT o_orderkey AS id,
  'SRC_'||(year(o_orderdate)+(o_orderkey%4)*8)||CASE o_orderkey%3 WHEN 0 THEN '_notice_' WHEN 1 THEN '_master_circular_' ELSE '_order_' END||o_orderkey||'.txt' AS document,
  'Circular '||o_orderkey||' is hereby amended with effect from '||year(o_orderdate)||'. Limit of Rs. '||(o_custkey%500)||'.25 crore applies if the order is superseded.'
   ||CASE WHEN o_orderkey%5=0 THEN ' The earlier circular of 01/04/1998 and the notification of March 2004 stand modified; see regulation 7.' ELSE '' END AS text
  FROM orders)"""

SUBMISSIONS = """submissions AS (SELECT event_id, 'org/sys'||(user_id%50) AS hf_id, (event_id*37%1000)/1000.0::DOUBLE AS overall,
  (event_id*91%1000)/1000.0::DOUBLE AS score_REG, ts AS submitted_at FROM events)"""

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def quoted(x: str) -> str:
    """A text as an SQL literal, line feeds as chr(10)."""
    return "||chr(10)||".join("'" + line.replace("'", "''") + "'" for line in x.split("\n"))


def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x},''), '{SPACE}+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def normalise(x: str) -> str:
    kept = rf"regexp_replace(lower(coalesce({x},'')), '[^\p{{L}}\p{{N}}_%.\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, '{SPACE}+', ' ', 'g'))"


def numbers(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({x}, '\p{{Nd}}[\p{{Nd}},]*\.?\p{{Nd}}*')))"


def lenient_numbers(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all(translate(lower({x}), '₹,', ''), '\p{{Nd}}+(?:\.\p{{Nd}}+)?')))"


def same(a: str, b: str) -> str:
    return f"(len({a})>0 AND len({b})>0 AND {a}={b})"


def yn(x: str, other: str) -> str:
    return f"CASE WHEN starts_with({x},'yes') THEN 'yes' WHEN starts_with({x},'no') THEN 'no' ELSE {other} END"


def count_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def wilson(k: str, n: str) -> dict[str, str]:
    p = f"({k}*1.0/{n})"
    den = f"(1+3.8416/{n})"
    center = f"(({p}+3.8416/(2.0*{n}))/{den})"
    half = f"(1.96*sqrt({p}*(1-{p})/{n}+3.8416/(4.0*{n}*{n}))/{den})"
    return {"accuracy": p, "ci_lower": f"greatest(0.0,{center}-{half})", "ci_upper": f"least(1.0,{center}+{half})", "center": center, "half_width": half}


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts: a dynamic program over lists."""
    return f"""CASE WHEN length({a})=0 OR length({b})=0 THEN 0 ELSE list_last(list_reduce(
    list_prepend(list_transform(range(0, length({b})+1), lambda z: 0::BIGINT), list_transform(string_split({a},''), lambda ch: [unicode(ch)::BIGINT])),
    lambda dp, ch: list_reduce(
      list_prepend([0::BIGINT], list_transform(range(1, length({b})+1), lambda j: [CASE WHEN unicode(substr({b}, j, 1)) = ch[1] THEN dp[j]+1 ELSE dp[j+1] END])),
      lambda acc, v: list_append(acc, greatest(acc[len(acc)], v[1]))))) END"""


def bootstrap_tail(source: str, keys: str) -> str:
    """CTEs that end in ``tail(keys, p_value)``: the exact tail of a centred multinomial difference, from n, only_a and only_b."""

    def power(count: str, share: str) -> str:
        return f"CASE WHEN {count}=0 THEN 0 WHEN {share}=0 THEN NULL ELSE {count}*ln({share}/n::DOUBLE) END"

    terms = f"lgamma(n+1)-lgamma(x+1)-lgamma(y+1)-lgamma(n-x-y+1)+{power('x', 'only_a')}+{power('y', 'only_b')}+{power('(n-x-y)', '(n-only_a-only_b)')}"
    return f"""tl1 AS (SELECT {keys}, n, only_a, only_b, unnest(range(0, only_a+only_b+CASE WHEN only_a+only_b=0 THEN 1 ELSE n-only_a-only_b+1 END)) AS x FROM {source}),
tl2 AS (SELECT *, unnest(range(0, n-x+1)) AS y FROM tl1 WHERE x<=n),
tail AS (SELECT {keys}, least(coalesce(sum(exp({terms})) FILTER (abs(x-y-(only_a-only_b))>=abs(only_a-only_b)), 0), 1.0) AS p_value FROM tl2 GROUP BY ALL)"""


def t_tail(r: str, n: str) -> str:
    """Two-sided p-value of a correlation: Simpson's rule on the density of t between zero and the statistic."""
    df, steps = f"({n}-2)", 4000
    t = f"(abs({r})*sqrt({df}/(1-{r}*{r})))"
    return f"""1-2*{t}/{3*steps}*exp(lgamma(({df}+1)/2.0)-lgamma({df}/2.0))/sqrt({df}*pi())*list_sum(list_transform(range(0,{steps}+1),
 lambda i: CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END*pow(1+pow({t}*i/{steps}.0,2)/{df},-({df}+1)/2.0)))"""


def chi2_tail(x: str, df: str) -> str:
    """Upper tail of chi-square: one less the series of the lower incomplete gamma function."""
    return f"""1-list_sum(list_transform(range(0,400), lambda i: exp(({df}/2.0+i)*ln({x}/2.0)-{x}/2.0-lgamma({df}/2.0+i+1))))"""


def token_set_ratio(source: str, key: str, a: str = "rn", b: str = "pn") -> str:
    """CTEs that end in ``tsr(key, ratio)``; the subsequence is a dynamic program over lists."""
    return f"""tsr0 AS (SELECT {key}, list_distinct({words(a)}) AS ta, list_distinct({words(b)}) AS tb FROM {source}),
tsr1 AS (SELECT {key}, len(ta) AS na, len(tb) AS nb, list_filter(ta, lambda t: list_contains(tb,t)) AS si,
  array_to_string(list_sort(list_filter(ta, lambda t: NOT list_contains(tb,t))),' ') AS xa,
  array_to_string(list_sort(list_filter(tb, lambda t: NOT list_contains(ta,t))),' ') AS xb FROM tsr0),
tsr2 AS (SELECT *, length(array_to_string(si,' ')) AS ls, length(xa) AS la, length(xb) AS lb,
  CASE WHEN length(xa)=0 OR length(xb)=0 THEN 0 ELSE list_last(list_reduce(
    list_prepend(list_transform(range(0, length(xb)+1), lambda z: 0::BIGINT), list_transform(string_split(xa,''), lambda ch: [unicode(ch)::BIGINT])),
    lambda dp, ch: list_reduce(
      list_prepend([0::BIGINT], list_transform(range(1, length(xb)+1), lambda j: [CASE WHEN unicode(substr(xb, j, 1)) = ch[1] THEN dp[j]+1 ELSE dp[j+1] END])),
      lambda acc, v: list_append(acc, greatest(acc[len(acc)], v[1]))))) END AS lcs FROM tsr1),
tsr AS (SELECT {key}, CASE WHEN na=0 OR nb=0 THEN 0.0::DOUBLE WHEN ls>0 AND (la=0 OR lb=0) THEN 100.0::DOUBLE
  ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE*(la+lb-2*lcs)/(2*(ls+CASE WHEN ls>0 THEN 1 ELSE 0 END)+la+lb),
    CASE WHEN ls>0 THEN 100.0::DOUBLE - 100.0::DOUBLE*(1+la)/(2*ls+1+la) ELSE 0 END,
    CASE WHEN ls>0 THEN 100.0::DOUBLE - 100.0::DOUBLE*(1+lb)/(2*ls+1+lb) ELSE 0 END) END AS ratio FROM tsr2)"""


def scored_pairs() -> str:
    """CTEs of answer_pairs with normalised text and ratio (``sp``)."""
    return (
        PAIRS + f""",
np AS (SELECT *, {normalise('reference')} AS rn, {normalise('prediction')} AS pn FROM answer_pairs),
""" + token_set_ratio("np", "item_id") + """,
sp AS (SELECT np.*, tsr.ratio FROM np JOIN tsr USING (item_id))"""
    )
