"""Hard negatives, collocations and main texts against brute force and planted cases."""

from __future__ import annotations

import random
import re
import tracemalloc
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import collocations, hard_negatives, host_arrays

VECTORS = "vec_id long, embedding array<double>, label int, score string, uid int, slot int"
TEXTS = "lang string, text string, phrase int, words string, n int"
PAGES = "page_id long, url string, html string, text int, stream string, host int"


def negatives(rows, positives=5, negatives=3, low=50, high=95):
    """Brute force; rows are (vec_id, vector, label, is_anchor)."""
    rows = sorted({(i, tuple(v), y, q) for i, v, y, q in rows}, key=lambda r: (r[0], r[1]))
    out = []
    for i, a, y, _ in (r for r in rows if r[3]):
        scored = sorted((-sum(x * z for x, z in zip(a, v)), j, k) for j, v, k, _ in rows if j != i and len(v) == len(a))
        for ps, p, _ in [s for s in scored if s[2] == y][:positives]:
            fits = [(s, j) for s, j, k in scored if k != y and -low * ps <= -100 * s <= -high * ps][:negatives]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(fits)]
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-9, 12, 6) / 256).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(400)]
    rows += [(400 + i, rows[i][1], rows[i + 1][2]) for i in range(40)] + [rows[50], rows[7]]
    return rows


def test_negatives_match_brute_force(spark, vectors, monkeypatch):
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 6, 0), (903, [float("inf")] * 6, 0), (904, [0.1] * 6, None), (None, [0.1] * 6, 0), (950, [0.5, 0.25], 0), (951, [0.5, 0.25], 1), (952, [0.5, 0.2], 0), (1000, [], 1), (1001, [], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in vectors + odd], VECTORS)
    held = [(i, [int(np.floor(256 * x)) for x in v], y, i % 50 == 0) for i, v, y in vectors + [r for r in odd[6:]]]
    wanted = negatives(held)
    monkeypatch.setattr(hard_negatives, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 3)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == wanted and len(wanted) > 50
    assert hard_negatives.mine(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("size", [3, 300, 2**20, 2**25, 2**28])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    for n, m, d in ((1, 1, 1), (7, 3, 5), (65, 4, 64), (0, 2, 3), (5, 2, 0)):
        v, a = rng.integers(-size, size + 1, (n, d)), rng.integers(-size, size + 1, (m, d))
        block = hard_negatives.PackedBlock(v, a.min(0), a.max(0))
        assert block.scores(a).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in v] for p in a]
        assert size > 300 or block.fields > 1


def mined(rows, support, top):
    """Brute force of the scores."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    out = []
    for (lang, w), a in often.items():
        if any(lang == g and b >= a and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x))) for (g, x), b in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    found = Counter()
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        found.update((g, i + 1, p, a, l, r, n, s) for i, (g, s, a, p, l, r, n) in enumerate(mine))
    return found


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(4)
    words = ["New", "york", "city", "Über", "a\x0bb", "x", "y", "z", "straße", "o'clock"]
    line = lambda n: "".join(rng.choices(words, [9, 8, 7, 2, 1, 1, 1, 1, 1, 1])[0] + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " "]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "de", None]), line(rng.randint(0, 60))) for _ in range(300)]
    return rows + [("en", "the quick brown fox jumps over. " * 40), ("fr", "rare words only"), ("en", None), ("en", ""), ("", "new york " * 30), rows[0], rows[0], ("en", ".,;:!? \t\n")]


def test_collocations_match_brute_force(spark, sentences):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in sentences], TEXTS).repartition(5)
    for support, top, words in ((8, 2000, 10**6), (8, 5, 100), (15, 40, 700)):
        got = collocations.collocations(df, support, top, block_words=words, bits=1 << 12)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert Counter(tuple(r) for r in got.collect()) == mined(sentences, support, top)
    assert any(r.phrase == "the quick brown fox jumps" for r in collocations.collocations(df, 8).collect())
    assert collocations.collocations(df.where("lang = 'no'"), 8).collect() == []


def test_only_words_of_phrases_are_counted(spark, sentences):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in sentences], TEXTS).repartition(40)
    counts = collocations.phrase_counts(df, 8, block_words=1)
    used = {w for r in counts.where("words > 1").collect() for w in r.phrase.split(" ")}
    assert used and {r.phrase for r in counts.where("words = 1").collect()} == used


def test_shards_share_the_support(spark):
    """A phrase of one occurrence per shard is found although no shard holds two; rarer pairs are left out early."""
    rows = [("en", f"red kite {i} unique{i} pair{i}", 1, "x", 2) for i in range(8)]
    df = spark.createDataFrame(rows, TEXTS).repartition(8)
    assert [(r.phrase, r.a) for r in collocations.collocations(df, 8).collect()] == [("red kite", 8)]


def test_counting_tasks_do_not_grow_in_number_with_the_texts(spark, sentences):
    """op12: tasks each count nearly all candidates, so they are as few as the cores until their texts are large."""
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in sentences], TEXTS).repartition(40)
    cores = spark.sparkContext.defaultParallelism
    assert collocations.gathered(df, 10**6).rdd.getNumPartitions() == cores < 40
    assert collocations.gathered(df, (cores + 3) * collocations.TASK_BYTES - 1).rdd.getNumPartitions() == cores + 3
    assert collocations.gathered(df.repartition(2), 0).rdd.getNumPartitions() == 2


def test_a_task_passes_on_repeated_phrases_once(monkeypatch):
    """op12: counts of blocks are merged again and again while they stay few."""
    monkeypatch.setattr(collocations, "HELD_ROWS", 12)
    every = SimpleNamespace(value=np.full(1 << 6, -1, np.int64).view(np.uint64))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["red kite"]})
    made = [r for b in collocations._count(every, 1)(iter([batch] * 50)) for r in b.to_pylist()]
    assert sorted((r["phrase"], r["words"], r["n"]) for r in made) == [("", 0, 100), ("kite", 1, 50), ("red", 1, 50), ("red kite", 2, 50)]


@pytest.mark.parametrize("last", [0, 1, 5])
def test_a_block_is_gone_before_the_next_is_read(monkeypatch, last):
    """op12: a worker holds one block, and no parts of it."""
    read, made, alive = collocations.read, [], []

    def seen(batch):
        alive.append(sum(ref() is not None for ref in made))
        block = read(batch)
        made.append(weakref.ref(block.codes))
        return block

    monkeypatch.setattr(collocations, "read", seen)
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    every = SimpleNamespace(value=np.full(1 << 6, -1, np.int64).view(np.uint64))
    run = collocations._mine(min(last, 3), last, every, 1) if last else collocations._count(every, 1)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a red kite and a red fox"]})
    assert sum(b.num_rows for b in run(iter([batch] * 5))) and alive == [0] * 5


def test_texts_reach_workers_in_small_batches(spark):
    """op12: batches are bounded by bytes while phrases are counted; a bound that the session sets holds."""
    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([("x" * 1_000_000,)] * 12, "text string").coalesce(1)
    sizes = lambda: [r.n for r in texts.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()]
    with collocations.small_batches(spark):
        assert max(sizes()) <= 6
    assert spark.conf.get(key, None) is None and max(sizes()) > 6
    spark.conf.set(key, 1 << 20)
    try:
        with collocations.small_batches(spark):
            assert spark.conf.get(key) == str(1 << 20)
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key)


def test_levels_take_few_bytes_a_word():
    """op12: two workers of an executor count blocks of 2 million words at a time."""
    rng = np.random.default_rng(5)
    n = 400_000
    vocab = pa.array([str(i).encode() for i in range(n // 10)])
    block = collocations.Block((rng.random(n) ** 4 * len(vocab)).astype(np.int32), np.full(n, 5, np.uint8), np.zeros(n, np.int32), vocab, pa.array(["en"]), n)
    block.room[-5:] = np.arange(5, 0, -1)
    known = collocations._known(np.full(1 << 10, -1, np.int64).view(np.uint64), collocations.Hasher(block))
    tracemalloc.start()
    try:
        found = [(k, len(places), int(counts.sum())) for k, places, counts in collocations.levels(block, 5, known)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    words = block.codes.tolist()
    assert found == [(k, len({tuple(words[i : i + k]) for i in range(n - k + 1)}), n - k + 1) for k in range(1, 6)]
    assert peak < 80 * n


def page(main: str, menu: str = "", extra: str = "") -> str:
    return f"<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body>{menu}<div>{main}</div>{extra}</body></html>"


def extracted(df, **kw):
    return {r.page_id: r.text for r in host_arrays.extract(df, **kw).collect()}


def test_marked_parts_are_left_out(spark):
    cases = {
        1: ("<article><h1>A &amp; B</h1><p>one\n two<br>three</p><nav>menu</nav><div class='share-buttons'>tweet</div><p>four&nbsp;five</article><footer>f</footer>", "A & B\none two three\nfour five"),
        2: ("<header>top</header><main><h2>H</h2><ul><li>x<li>y</ul><aside>side</aside><form>q<input></form></main><section id='comments'><p>nice</p></section>", "H\nx\ny"),
        3: ("<div class='cookie-notice'>ok?</div><div class='post'><p>body <b>bold</b>text</p></div><div class=sidebar>s</div>", "body boldtext"),
        4: ("<article><header><h1>Title</h1><p>by me</p></header><p>text<p>more<!-- <p>gone</p> --><style>p{}</style></article>", "Title\ntext\nmore"),
        5: ("<article><div class='comment'><p>reader</p></div><p class='with-sidebar'>kept</p><p>a<span class='advert'>buy</span>b</p></article>", "kept\na\nb"),
        6: ("", ""), 7: (None, ""), 8: ("plain &lt;words&gt; &copy &#233; &am", "plain <words> © é &am"), 9: ("<nav>only menus", ""), 10: ("<p>" + "long words " * 50_000, ("long words " * 50_000).strip()),
        11: ("<div hidden>no</div><table><tr><td>1<td>2</table><p>unclosed <b>x", "1\n2\nunclosed x"), 12: ("<main>around<article>inside</article>after</main>", "inside"),
    }
    df = spark.createDataFrame([(i, f"http://h{i}.example/", h, 1, "x", 2) for i, (h, _) in cases.items()], PAGES)
    assert extracted(df) == {i: t for i, (_, t) in cases.items()}


def test_repeats_on_a_host_are_boilerplate(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    text = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    menu = "<div>" + " ".join(f"menu{i}" for i in range(12)) + "</div>"
    rows = [(i, f"https://big.example/{i}", page(f"<p>{text[i]}</p>", menu)) for i in range(40)]
    rows += [(40, "https://other.example/1", page(f"<p>{text[40]}</p>", menu)), (41, "https://BIG.example:80/a", page(f"<p>{text[0]}</p><p>{text[41]}</p>")), (42, None, page(f"<p>{text[42]}</p>")), (None, "https://big.example/0", page(f"<p>{text[43]}</p>", menu))]
    rows += [rows[0], (44, "https://big.example/copy", rows[1][2]), (45, "https://big.example/same", "<article>" + text[2] + "</article>")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], PAGES).repartition(4)
    want = {i: text[i] for i in range(40)} | {40: " ".join(f"menu{i}" for i in range(12)) + "\n" + text[40], 41: text[41], 42: text[42], None: text[43], 44: text[1], 45: text[2]}
    # The text of page 0 stands on page 41 too, with another one: there it is a repeat. Page 0, all of whose blocks stand elsewhere, stays whole.
    want[0] = " ".join(f"menu{i}" for i in range(12)) + "\n" + text[0]
    assert extracted(df) == want
    assert host_arrays.extract(df).count() == len(rows)
    # Hosts above the size of an array are dealt to many arrays; repeats across these count alike.
    assert extracted(df, array_bytes=900) == want
    assert host_arrays.extract(df.where("page_id < 0")).collect() == []


def test_suffix_ranks_order_equal_beginnings():
    tokens = np.array([5, 6, 7, 5, 6, 7, 8, 5, 6, 7, 8], np.uint64)
    rank = host_arrays.sorted_suffixes(tokens, np.arange(11, 0, -1), 3)
    assert rank[0] == rank[3] == rank[7] and rank[4] == rank[8] and len(set(rank[:9].tolist())) == 6 and rank[9] == -1
