"""The training-data operators against brute force, and on awkward tables."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import ann, common, decontam, html, mixing, neardup, quality, tokens, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, kind=r"[^\x20\x09-\x0D]+"):
    return re.findall(kind, (text or "").translate(LOWER))


def frame(spark, texts, first=0):
    rows = [(first + i, t, ("en", "de", "fr", "es")[i % 4], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and a column of a clashing name."""
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "word " * 30_000), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "no id here at all"), (7, "a b c d e f g")]
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)
    return df.withColumn("score", F.lit("x")).withColumn("key", F.lit(1))


LABELS = "doc_id long, quality int, toxic int"


def test_words_match_regex():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcAé \n\t.")) for _ in range(rng.integers(0, 60))) for _ in range(200)] + ["", None, "x" * 200]
    old, common.SLICE = common.SLICE, 64
    try:
        hashes, first = common.words(*common.utf8(pa.array(texts)))
    finally:
        common.SLICE = old
    seen = {}
    for t, a, b in zip(texts, first, first[1:]):
        own = words(t)
        assert len(own) == b - a
        for w, h in zip(own, hashes[a:b]):
            assert seen.setdefault(w, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[301] == 300 and 200 not in got


def test_quality(spark):
    good = ["The river runs past the old mill, and then it turns." + f" Line {i}." for i in range(120)]
    bad = ["BUY!! NOW!! $$$ %%% FREE!! " * 3 + str(i) for i in range(60)]
    docs = frame(spark, good + bad)
    labels = docs.select("doc_id", (F.col("doc_id") < 120).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == (i < 120) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = odd_docs(spark)
    assert quality.score(odd, model, ["doc_id"]).count() == 9
    assert quality.accept(odd, model).columns == odd.columns
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0
    empty = quality.train(docs, labels.limit(0))
    assert quality.accept(docs, empty).count() == 180


def test_machine_is_linear_form_of_pairs():
    m = quality.FactorisationMachine(width=6, rank=3)
    m.linear[:] = np.arange(6) / 10
    m.factors[:] = np.random.default_rng(0).normal(size=(6, 3))
    index, value = np.array([0, 2, 5]), np.array([1.0, 0.5, 2.0], np.float32)
    pairs = sum(float(m.factors[a] @ m.factors[b]) * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[i + 1 :])
    assert m.raw(index, value, np.array([0, 3]))[0][0] == pytest.approx(float(m.linear[index] @ value) + pairs, rel=1e-5)


def brute_duplicates(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1500)  # several blocks for the large group
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 7)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 8)):
            own[j] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 50)) for _ in range(40)] + [texts[3], texts[3].upper(), "", None, "one two"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts), k, percent).collect()}
    assert got == brute_duplicates(list(enumerate(texts)), k, percent)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
    texts = [" ".join([*base[:50], *(f"e{rng.integers(0, 3)}" for _ in range(3))]) for _ in range(12)] + [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(8)]
    docs, bench = frame(spark, texts), spark.createDataFrame([(0, " ".join(base[:20]))], "item_id long, text string")
    near = sorted(map(tuple, neardup.near_duplicates(docs, 3, 85).collect()))
    found = sorted(map(tuple, decontam.digest(decontam.hits(docs, bench)).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, neardup.near_duplicates(docs, 3, 85).collect())) == near
    assert sorted(map(tuple, decontam.digest(decontam.hits(docs, bench)).collect())) == found and sum(r[5] for r in found) == 12


def test_near_duplicates_odd(spark):
    odd = odd_docs(spark)
    rows = neardup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == 9 and {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    kept = neardup.deduplicate(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert neardup.near_duplicates(odd.limit(0), 3, 85).count() == 0


def test_likelihood_prefers_the_truth():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])  # similarity 1800 / 2200
    ra, rb = neardup.registers(a, 1024), neardup.registers(b, 1024)
    up, down = (ra > rb).sum(), (ra < rb).sum()
    at = [neardup.slope(np.array([up]), np.array([1024 - up - down]), np.array([down]), 2000.0, np.array([2000.0]), j)[0] for j in (0.7, 0.92)]
    assert at[0] > 0 > at[1]


def test_decontamination_against_search(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (13, 20, 40, 5, 1)] + ["", None]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(60)]
    for i in range(0, 30, 2):
        texts[i] += " X-" + str(items[i % 5]).upper() + ". " + texts[i + 1]
    docs, bench = frame(spark, [*texts, None]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.digest(decontam.hits(docs, bench)).collect()}
    kind = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for i, t in enumerate([*texts, None]):
        w, hit, found = words(t, kind), set(), set()
        for n, item in enumerate(items):
            x = words(item, kind)
            size = min(13, len(x))
            for k in range(len(x) - size + 1 if size else 0):
                for s in range(len(w) - size + 1):
                    if w[s : s + size] == x[k : k + size]:
                        hit.update(range(s, s + size))
                        found.add(str(n))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(found))
        assert got[i]["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))
    odd = odd_docs(spark)
    assert decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.hits(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_proximity(spark):
    docs = frame(spark, ["alpha x beta", "beta y y alpha", "alpha q q q q beta", "alpha"])
    assert sorted(tuple(r) for r in decontam.proximity_matches(docs, ["Alpha", "beta"], 4).collect()) == [(0, 0, 3), (1, 0, 4)]


def test_tokens_against_library(spark):
    rng = np.random.default_rng(4)
    pieces = ["'s", "'re", " ", "\n", "a", "é", "1", "!", "\t", "'", "中", "  ", "😀", "<|endoftext|>", "word", "'ll"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 25))) for _ in range(400)] + [None, ""]
    encoder = tokens.Encoder(tokens.vocabulary())
    ids, counts = encoder.encode(texts)
    wanted = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in wanted] and ids.tolist() == [y for x in wanted for y in x]
    rows = tokens.token_output(frame(spark, texts)).orderBy("doc_id").collect()
    start = 0
    for r, x in zip(rows, wanted):
        own = np.array([*x, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own))
        start += len(own)
    assert tokens.token_output(odd_docs(spark)).count() == 9 and tokens.token_output(odd_docs(spark).limit(0)).count() == 0


def test_shard_random_access(tmp_path):
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**32 - 1, *range(3000)], np.uint32)
    data = tokens.pack(ids, np.array([5, 9]), np.array([False, True]), np.array([7, len(ids)]))
    tokens.save_shard(f"file://{tmp_path}/s", data)
    shard = tokens.open_shard(f"file://{tmp_path}/s")
    rng = np.random.default_rng(1)
    for a, b in rng.integers(0, len(ids) + 1, (200, 2)):
        assert shard.slice(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()
    assert shard.ids().tolist() == ids.tolist() and [shard[i] for i in range(len(ids))] == ids.tolist()
    assert shard.document(0).tolist() == ids[:7].tolist() and shard.nulls.tolist() == [False, True]
    with pytest.raises(ValueError):
        tokens.Shard(data[:-1] + b"x")
    with pytest.raises(IndexError):
        shard[len(ids)]


def test_context_limits(spark):
    texts = ["word " * n for n in (0, 1, 1, 3, 2000, 5)] + [None]
    histogram = tokens.length_histogram(frame(spark, texts))
    lengths = [len(tokens.Encoder(tokens.vocabulary()).tokenizer.encode(t or "").ids) for t in texts]
    for r in tokens.context_limits(histogram).collect():
        n = r["limit_tokens"]
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths) and r["docs_over"] == sum(x > n for x in lengths)
        assert r["total_tokens"] == sum(lengths) and r["docs_within"] == sum(x <= n for x in lengths) and r["tokens_within"] == sum(x for x in lengths if x <= n)


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    vectors[300:340] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    x = vectors.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        order = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        hit += len({i for _, i in mine} & set(order.tolist()))
        total += 5
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        if q == 300:
            assert [i for _, i in mine] == [301, 302, 303, 304, 305]
    assert hit / total >= 0.9
    assert ann.nearest_neighbours(df.where("vec_id > 4999"), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id in (50, 51, 52)")
    assert ann.nearest_neighbours(few, F.col("vec_id") % 50 == 0).count() == 2


def test_balanced_parts():
    rng = np.random.default_rng(7)
    x = ann._unit(rng.normal(size=(1000, 8)))
    graph = ann.nearest(x, x, 5, True)
    assert np.bincount(ann.balanced_parts(graph, 8)).tolist() == [125] * 8
    assert sorted(set(np.bincount(ann.balanced_parts(graph, 64, x.astype(np.float32))))) == [15, 16]


def ann_truth(vectors, queries, k=5):
    x = vectors.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[q]
        s[q] = -9
        out[q] = set(np.argsort(-s, kind="stable")[:k].tolist())
    return out


def test_ann_prunes_and_keeps_recall(spark):
    rng = np.random.default_rng(16)
    vectors = rng.normal(size=(12_000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    common.prepare(spark)
    index = ann.Index.build(ann.usable_rows(df))
    assert index.router.parts > 256 and index.router.probes < index.router.parts / 2 and index.counts.sum() == ann.COPIES * 12_000
    queries = list(range(0, 12_000, 100))
    asked = ann.usable_rows(df.where("vec_id % 100 = 0"))
    got = {}
    for r in index.search(asked).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    truth = ann_truth(vectors, queries)
    assert sum(len(got[q] & truth[q]) for q in queries) >= 0.88 * 5 * len(queries)


def test_ann_index_insert_remove_rebuild_save(spark, tmp_path):
    rng = np.random.default_rng(17)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    frame_of = lambda a, b: ann.usable_rows(spark.createDataFrame([(i, vectors[i].tolist()) for i in range(a, b)], "vec_id long, embedding array<float>"))
    common.prepare(spark)
    index = ann.Index.build(frame_of(0, 300))
    more = index.insert(frame_of(300, 400))
    asked = frame_of(0, 10)
    found = lambda i: {r["query_id"]: r["vec_id"] for r in i.search(asked).where("rank = 1").collect()}
    truth = {q: next(iter(t)) for q, t in ann_truth(vectors, range(10), 1).items()}
    index_of_all = dict(found(more))
    assert index_of_all == truth or more.router.parts > 1
    gone = more.remove(spark.createDataFrame([(index_of_all[0],)], "id long"))
    assert found(gone)[0] != index_of_all[0] and gone.stats()["rows"] < more.stats()["rows"]
    gone.save(str(tmp_path / "index"))
    again = ann.Index.load(spark, str(tmp_path / "index"))
    assert found(again) == found(gone) and again.stats() == gone.stats()
    assert gone.vectors().count() == 399


def test_ann_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(18)
    vectors = rng.normal(size=(900, 6)).astype(np.float32)
    vectors[200:600] = vectors[200]  # one vector in many blocks
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(3, vectors[7].tolist())], "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("part", F.lit(1))
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id").isin(0, 200, 300, 599)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[200] == [201, 202, 203, 204, 205] and got[300] == got[599] == [200, 201, 202, 203, 204] and len(got[0]) == 5


def test_html_held_out_layouts():
    model = html.default_model()
    pages = html.training_pages(120, 77)
    got = model.extract([p for p, _ in pages])
    assert sum(g == "\n\n".join(b) for (_, b), g in zip(pages, got)) >= 0.9 * len(pages)


def test_html_marginals_are_exact():
    tree = html.parse("<div class=ad>x<p>y</p></div><p>z</p>")
    model = html.default_model()
    forest = html.Forest([tree], model.slots)
    belief = html.marginals(forest, model.weights, model.pair)[0]
    unary = np.bincount(forest.node, model.weights[forest.slot], forest.n)
    weight = np.zeros((forest.n, 2))
    for code in range(2**forest.n):
        s = [(code >> i) & 1 for i in range(forest.n)]
        total = sum(u * v for u, v in zip(unary, s)) + sum(model.pair[forest.edge[i], 2 * s[forest.parent[i]] + s[i]] for i in range(1, forest.n))
        for i, v in enumerate(s):
            weight[i, v] += np.exp(total)
    assert np.allclose(belief, np.log(weight[:, 1] / weight[:, 0]))


def test_html_page(spark):
    page = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy this.</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<br>four.<p>Five &lt;6&gt;<!-- x --></article><footer>&copy; x</footer></body>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\n\nOne two three four.\n\nFive <6>" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[4]["text"] == "deep"


def test_urls(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.Example.NET/en/x?q#f"), (3, "http://example.net"), (4, "https://x.org/fr/1"), (5, "http://b.example.com/de/9"), (6, "http://net/y"), (7, "ftp://q.example.com/it/a")]
    rows += [(10 + i, f"http://h{i % 7}.example.net/{'en' if i % 2 else 'de'}/{i}") for i in range(200)]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("", "", None) and got[1]["host"] == ""
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3]["rule"] is None and got[4]["rule"] == "org/fr/" and got[5]["verdict"] == "block" and got[6]["rule"] == "net/"
    assert all(got[10 + i]["verdict"] == ("allow" if i % 2 else "block") for i in range(200))
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_against_python(spark):
    rows = [(i, f"http://h{i % 5}.example.net/{'en' if i % 3 else 'de'}/{i}") for i in range(90)] + [(100, "http://q.example.com/en/5")]
    got = {r["page_id"]: r["score"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    a = urls.ALPHABET

    def coded(u):
        t = u.split("://")[1].lower()
        return [urls.SYMBOLS.find(re.sub("[1-9]", "0", ch)) + 1 for ch in t]

    counts = [{}, {}]
    held = {r["page_id"] for r in spark.createDataFrame(rows, "page_id long, url string").where(f"pmod(xxhash64(url), {urls.HELD}) = 0").collect()}
    assert 5 < len(held) < 45
    for i, u in [r for r in rows[:90] if r[0] not in held]:
        c = [urls.START] * urls.ORDER + coded(u)
        for j in range(urls.ORDER, len(c)):
            for o in range(urls.ORDER + 1):
                cell = counts[0 if "/en/" in u else 1].setdefault(tuple(c[j - o : j]), {})
                cell[c[j]] = cell.get(c[j], 0) + 1
    both = lambda ctx: sum(sum(x.get(ctx, {}).values()) for x in counts)
    total = both(())

    def prob(k, ctx, s):
        prior = prob(k, ctx[1:], s) if ctx else 1 / a
        cell = counts[k].get(ctx, {})
        return (cell.get(s, 0) + urls.BACKOFF * prior) / (sum(cell.values()) + urls.BACKOFF)

    for i in (0, 1, 100):
        u = dict(rows)[i]
        c = [urls.START] * urls.ORDER + coded(u)
        gain = 0.0
        for j in range(urls.ORDER, len(c)):
            o = max(n for n in range(urls.ORDER + 1) if n == 0 or both(tuple(c[j - n : j])) >= urls.SHARE * total)
            ctx = tuple(c[j - o : j])
            gain += np.log(prob(0, ctx, c[j]) / prob(1, ctx, c[j]))
        assert got[i] == pytest.approx(gain / (len(c) - urls.ORDER), rel=1e-6)


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    plain = [f"k{x}" for x in range(300)]
    insults = ["grumbag", "grumbold", "snotwit", "snotface"]
    texts = []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 5 == 0:
            for j in rng.integers(0, 40, 4):
                w[j] = str(rng.choice(insults))
        texts.append(" ".join(w))
    docs = frame(spark, texts)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    grammar = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, grammar).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == (i % 5 == 0) for i in held)
    odd = toxicity.score(odd_docs(spark), grammar)
    assert odd.count() == 9 and odd.where("predicted = 1").count() == 0
    assert toxicity.train(docs, labels.limit(0)).lexicon.whole


def test_grammar_chain():
    step, out = toxicity.composed()

    def run(symbols):
        state, seen = 0, []
        for s in symbols:
            seen.append(int(out[state, s]))
            state = int(step[state, s])
        return [x for x in seen if x >= 0]

    i, t, y, n, r, o = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATED, toxicity.SPEECH, toxicity.NONE
    assert run([i]) == [0] and run([y, o, i]) == [1] and run([n, o, i]) == [2] and run([r, o, o, i]) == [3]
    assert run([n, o, o, o, i]) == [0] and run([t]) == [4] and run([n, t]) == [5] and run([i, o, y]) == [0, 6]


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"{'edfs'[i % 4]}{x}" for x in rng.integers(0, 50, rng.integers(5, 60))) for i in range(400)]
    docs = frame(spark, texts)
    got = mixing.rates(docs, docs.select("doc_id")).toPandas()
    total = got.n_tokens.sum()
    assert (got.rate >= 0).all() and total == sum(len(words(t)) for t in texts)
    for d, share in mixing.TARGETS.items():
        assert (got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total == pytest.approx(share, abs=1e-4)
    copies = mixing.resample(docs, docs.select("doc_id")).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert {r.doc_id: r.copies for r in got.itertuples() if r.copies} == copies
    odd = odd_docs(spark)
    assert mixing.resample(odd, docs.select("doc_id").limit(0)).count() == 9
    assert mixing.rates(odd.limit(0), docs.select("doc_id")).count() == 0
    assert mixing.resample(odd, odd.select("doc_id")).columns == odd.columns


def test_projection_keeps_rates_nonnegative(spark):
    rows = [(10, [0.9, 0.1]), (1000, [0.1, 0.9]), (5, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    steps = mixing.fit_rates(table, ["a", "b"], {"a": 0.99, "b": 0.01})
    rates = [r["r"] for r in table.select(mixing._rate(steps).alias("r")).collect()]
    assert min(rates) >= 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    good = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) + "." for _ in range(150)]
    texts = [*good, *good[:10], *["BUY!! $$$ %%% NOW!! " * 5 + str(i) for i in range(50)], " ".join(f"u{i}" for i in range(60)) + " zz1 zz2 zz3 zz4 zz5 zz6 zz7 zz8 zz9 zz10 zz11 zz12 zz13 zz14"]
    docs = frame(spark, texts)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    docs.select("doc_id", ((F.col("doc_id") < 160) | (F.col("doc_id") == 210)).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"zz{i}" for i in range(1, 15)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, d), "test")
        kept.append(docs.count())
    assert kept[:3] == [161, 151, 150] and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert isinstance(docs.schema["start"].dataType, T.LongType)


def test_mixing_against_plain_python(spark):
    """Posteriors by a dictionary of words, rates by projected gradient on plain arrays."""
    rng = np.random.default_rng(19)
    texts = [" ".join(f"{'edfs'[i % 4] if rng.random() < 0.8 else 'x'}{x}" for x in rng.integers(0, 30, rng.integers(1, 40))) for i in range(300)]
    docs = frame(spark, texts)
    common.prepare(spark)
    model = mixing.learn(docs, docs.select("doc_id"))
    table = mixing.posteriors(docs, model)
    got = {r["doc_id"]: r for r in table.collect()}
    held = {r["doc_id"] for r in docs.where("pmod(xxhash64(doc_id), 4) = 0").collect()}
    slot = lambda w: common.hash_word(w) & (mixing.SLOTS - 1)
    langs, counts, seen = sorted(mixing.TARGETS), {}, {}
    for i, t in enumerate(texts):
        if i not in held:
            lang = ("en", "de", "fr", "es")[i % 4]
            seen[lang] = seen.get(lang, 0) + 1
            for w in words(t):
                counts[lang, slot(w)] = counts.get((lang, slot(w)), 0) + 1
    total = {d: sum(n for (x, _), n in counts.items() if x == d) + 0.1 * mixing.SLOTS for d in langs}
    n, p = [], []
    for i, t in enumerate(texts):
        w = words(t)
        z = [model.sharpness * np.mean([np.log((counts.get((d, slot(x)), 0) + 0.1) / total[d]) for x in w]) + np.log((seen[d] + 0.1) / (sum(seen.values()) + 0.4)) for d in langs]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(got[i]["p"], e / e.sum(), atol=1e-4) and got[i]["n_tokens"] == len(w)
        n.append(len(w))
        p.append(got[i]["p"])
    n, p = np.array(n, float), np.array(p)
    wanted = n.sum() * np.array([mixing.TARGETS[d] for d in langs])
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    r = np.ones(len(n))
    for _ in range(2000):
        r = np.maximum(0, r - p @ inverse @ ((r * n) @ p - wanted))
    steps = mixing.fit_rates(table, langs, mixing.TARGETS)
    mine = {x["doc_id"]: x["r"] for x in table.select("doc_id", mixing._rate(steps).alias("r")).collect()}
    assert steps.met and np.allclose([mine[i] for i in range(len(n))], r, atol=1e-3)


def test_mixing_says_that_targets_are_not_met(spark):
    table = spark.createDataFrame([(10, [1.0, 0.0]), (10, [1.0, 0.0])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="aren't met"):
        assert not mixing.fit_rates(table, ["a", "b"], {"a": 0.5, "b": 0.5}).met


# --- hashes, bytes, groups -----------------------------------------------------------------------


def thue_morse(n=1024):
    t = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_words_of_one_polynomial_hash_stay_apart(spark):
    one, two = thue_morse()
    encoder = tokens.Encoder(tokens.vocabulary())
    ids, counts = encoder.encode([one, two])
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (one, two)]
    assert ids.tolist() == wanted[0] + wanted[1] and counts.tolist() == [len(x) for x in wanted]
    docs = frame(spark, [one, two, f"{one} {two}"])
    assert {r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()} == {0, 1, 2}
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontam.digest(decontam.hits(docs, bench)).collect()) == [(0, 1), (1, 0), (2, 1)]
    lengths = {r["length"]: r["n_docs"] for r in tokens.length_histogram(docs.where("doc_id < 2")).collect()}
    assert sum(lengths.values()) == 2 and set(lengths) == {len(x) for x in wanted}


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash that gives every word the same number, tokens and phrases are still right."""
    monkeypatch.setattr(common, "hash_ranges", lambda data, starts, sizes: np.full(len(starts), 5, np.uint64))
    encoder = tokens.Encoder(tokens.vocabulary())
    texts = ["Some words, and more words!", "other things"]
    assert encoder.encode(texts)[0].tolist() == [y for t in texts for y in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    low, starts, sizes, hashes, _ = decontam.lower_words(pa.array(["alpha beta alpha gamma"]))
    found, order, ends = decontam.dictionary(low, starts, sizes, hashes)
    assert len(found.hashes) == 3 and sorted(np.diff(np.concatenate([[0], ends])).tolist()) == [1, 1, 2]
    assert sorted(found.find(hashes, low, starts, sizes).tolist()) == sorted(x for x in range(3) for _ in range(int(np.diff(np.concatenate([[0], ends]))[x])))


def test_merged_registers_are_those_of_the_union():
    rng = np.random.default_rng(20)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (700, 1500))
    both = neardup.registers(np.union1d(a, b), 222)
    assert np.array_equal(neardup.merge(neardup.registers(a, 222), neardup.registers(b, 222)), both)
    old, neardup.PIECE = neardup.PIECE, 512
    try:
        assert np.array_equal(neardup.registers(np.union1d(a, b), 222), both)
    finally:
        neardup.PIECE = old


def test_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (5, b + " end"), (9, "alone in here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (5, 1), (9, 9)]
    assert sorted(r["doc_id"] for r in neardup.deduplicate(docs, 3, 85).collect()) == [1, 9]


def test_large_group_of_short_near_copies_is_bounded():
    """What a task does for a block: near copies below the threshold, none of which links, and a group that links at once."""
    rng = np.random.default_rng(21)
    m = 222
    base = rng.integers(0, 2**63, 20).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:17], rng.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(neardup.BLOCK_DOCS)]
    regs = np.stack([neardup.registers(s, m) for s in sets])
    ids, comp, side = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(sets), np.int64)
    assert neardup.forest_of_links(ids, sets, regs, comp, side, 85) == []
    near = [np.unique(np.append(base, np.uint64(i))) for i in range(300)]
    regs = np.stack([neardup.registers(s, m) for s in near])
    links = neardup.forest_of_links(np.arange(300), near, regs, np.arange(300), np.zeros(300, np.int64), 85)
    assert len(links) == 299  # a forest, not pairs
    assert neardup.promising(np.full(300, 21), regs, np.zeros(300, np.int64), np.zeros(300, np.int64), 85).sum() == 0  # one component


def test_group_of_twenty_thousand_near_copies(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(f"w{i}" for i in range(30)) + " v"), F.col("id").cast("string")).alias("text"))
    got = neardup.near_duplicates(rows, 3, 85)
    assert got.agg(F.count(F.lit(1)).alias("n"), F.max("component_id").alias("c"), F.sum(F.col("kept").cast("int")).alias("k")).first()[:] == (20_000, 0, 1)


def test_decontamination_judges_each_row(spark):
    w = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(None, w), (None, "clean text"), (3, w), (3, " ".join(f"c{i}" for i in range(13))), (4, None), (5, "x " * 30_000 + w)], "doc_id long, text string").withColumn("text_key", F.lit(1)).withColumn("spans", F.lit("q"))
    bench = spark.createDataFrame([(1, w), (1, w), (None, "zz"), (2, None)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.digest(decontam.hits(docs, bench)).collect())
    assert got == [("3", 13, 0, 0, False), ("3", 13, 13, 1, True), ("4", 0, 0, 0, False), ("5", 30_013, 13, 1, False), ("None", 2, 0, 0, False), ("None", 13, 13, 1, True)]
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == 4
    assert decontam.hits(docs.limit(0), bench).count() == 0 and decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_slices_of_a_benchmark(spark, monkeypatch):
    rng = np.random.default_rng(22)
    items = [" ".join(f"i{x}" for x in rng.integers(0, 40, 20)) for _ in range(12)]
    docs = frame(spark, [f"{items[i]} filler {items[i + 1]} {items[0]}" for i in range(8)] + ["nothing here"])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    index = decontam.positional_index(docs)
    whole = sorted(map(tuple, decontam.digest(decontam.hits(docs, bench, index=index)).collect()))
    monkeypatch.setattr(decontam, "SLICE_WORDS", 30)
    monkeypatch.setattr(decontam, "PLACES", 2)
    assert sorted(map(tuple, decontam.digest(decontam.hits(docs, bench, index=index)).collect())) == whole and sum(r[5] for r in whole) == 8


def test_any_limit_and_quantile(spark):
    texts = ["word " * n for n in (0, 1, 1, 3, 2000, 5)] + [None]
    lengths = sorted(len(tokens.Encoder(tokens.vocabulary()).tokenizer.encode(t or "").ids) for t in texts)
    sums = tokens.context_limits(tokens.length_histogram(frame(spark, texts)))
    for r in tokens.at_limits(sums, [0, 2, 4, 100, 5000]).collect():
        n = r["limit_tokens"]
        assert (r["docs_over"], r["docs_within"], r["tokens_truncated"]) == (sum(x > n for x in lengths), sum(x <= n for x in lengths), sum(min(x, n) for x in lengths))
    for r in tokens.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        assert r["limit_tokens"] == min(x for x in lengths if sum(y <= x for y in lengths) >= r["share"] * len(lengths))
    none = tokens.context_limits(tokens.length_histogram(frame(spark, []).withColumn("length", F.lit(1))))
    assert none.count() == 0 and tokens.at_limits(none, [5]).count() == 0 and tokens.quantiles(none, [0.5]).count() == 0


def test_equal_and_missing_ids_are_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i} here") for i in range(400)], "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("part", F.lit("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = tokens.write_shards(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.select("part").distinct().count() > 2
    got = tokens.read_documents(shards).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 200 + [7] * 200
    encoder = tokens.Encoder(tokens.vocabulary())
    sums = sorted(zlib.crc32(np.array([*encoder.tokenizer.encode(f"text {i} here").ids, 0], "<u4")) for i in range(400))
    assert sorted(r["ids_crc32"] for r in got) == sums


# --- toxicity ------------------------------------------------------------------------------------

SENTENCES = {
    "You are an idiot": "aimed", "idiot, you": "late", "You aren't an idiot": "negated", "You aren’t an idiot": "negated", "I don't want to hurt you": "negated",
    "I will kill you": "late", "you will burn": "aimed", "“idiot” you are": "late", "you—idiot": "aimed", "he said idiot": "reported", "she told of threats to kill": "reported", "strangler": "", "ÉL ES UN IDIOTA": "aimed",
}


def test_sentences_are_read_by_the_grammar():
    grammar = toxicity.Grammar(toxicity.Lexicon({}, {}))
    names = {i: (x if isinstance(x, tuple) else ("plain", x))[0] for x, i in toxicity.OUTPUTS.items()}
    for text, wanted in SENTENCES.items():
        own = grammar.features(pa.array([text]))[0][: len(names)]
        seen = {names[i] for i in np.flatnonzero(own)}
        assert (wanted in seen) if wanted else not seen, (text, seen)
    score = lambda t: grammar.score(pa.array([t]))[0]
    assert score("You are an idiot") > 0.5 and score("I will kill you") > 0.5
    assert max(score(t) for t in ("You aren't an idiot", "I don't want to hurt you", "", "a strangler fig", "they said: to kill time")) < 0.5


def test_composed_machine_is_the_three_run_one_by_one():
    rng = np.random.default_rng(23)
    step, out = toxicity.composed()
    for _ in range(300):
        symbols = rng.integers(0, 6, rng.integers(1, 15)).tolist()
        stream: list = symbols
        for t in toxicity.CHAIN:
            state, passed = 0, []
            for s in stream:
                state, o = t.step(state, s)
                passed.append(o)
            stream = passed
        state, mine = 0, []
        for s in symbols:
            mine.append(int(out[state, s]))
            state = int(step[state, s])
        assert mine == [toxicity.OUTPUTS.get(s, -1) for s in stream]


def test_html_unclosed_media_and_split_references():
    model = html.default_model()
    for tag in ("video", "audio", "object", "svg", "noscript", "iframe"):
        page = f"<article><h1>A title here</h1><p>First paragraph of the text.</p><{tag} src=x><p>Second paragraph of the text.</p></article>"
        assert "Second paragraph of the text." in model.extract([page])[0], tag
    assert html._after_raw("<svg><svg></svg></svg>rest", "svg", 5) == 22
    assert model.extract(["<article><p>One &am<b>p;</b> two words and more of them.</p></article>"])[0] == "One &amp; two words and more of them."
    assert model.extract(["<div class=zuzu><a href=/>x</a></div><div class=newsroom><p>One paragraph that is the whole of the article, long enough to be read.</p></div><div class=wawa><a href=/>y</a></div>"])[0].startswith("One paragraph")
    assert model.extract(["<p>kept</p><script>never closed <p>no</p>"])[0] == "kept"


def test_registered_queries_have_the_columns_of_their_contracts(spark):
    from graphloom.llm import queries

    d = "/root/testdata/sf0.001"
    wanted = {
        "op1_quality": "doc_id bigint held_out boolean score double predicted int", "op3_url_filter": "page_id bigint host string path string rule string verdict string",
        "op4_near_duplicates": "doc_id bigint n_shingles bigint component_id bigint kept boolean", "op5_decontamination": "doc_id bigint n_words bigint n_hit bigint n_items bigint items_sha256 string contaminated boolean",
        "op6_nearest_neighbours": "query_id bigint rank int vec_id bigint score double", "op8_html_extraction": "page_id bigint url string text string n_chars bigint",
        "op9_toxicity": "doc_id bigint held_out boolean score double predicted int", "op10_token_output": "doc_id bigint start bigint n_tokens bigint ids_crc32 bigint",
    }
    for name, columns in wanted.items():
        parts = columns.split()
        got = queries.QUERIES[name](spark, d)
        assert dict(got.dtypes).items() >= dict(zip(parts[::2], parts[1::2])).items(), name
        rows_of = {"op3_url_filter": "pages", "op8_html_extraction": "pages"}.get(name, "documents")
        if name != "op6_nearest_neighbours":
            assert got.count() == spark.read.parquet(f"{d}/{rows_of}.parquet").count()


# --- odd tables ----------------------------------------------------------------------------------


def test_urls_odd(spark):
    rows = [(1, "http://a.example.net/en/x"), (1, "http://a.example.net/en/x"), (None, "http://net/" + "y" * 20_000), (2, "http://q.org/" + "z/" * 9000), (3, "://"), (4, ""), (5, "http://EXAMPLE.com/de/ä?b")]
    rows += [(10 + i, f"http://h{i}.example.net/{'en' if i % 2 else 'xx'}/{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("score", F.lit("s")).withColumn("codes", F.lit(2)).withColumn("held", F.lit(3))
    got = urls.filter_urls(df).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got} == {"allow", "block"}
    of = {r["page_id"]: r for r in got}
    assert (of[3]["host"], of[3]["path"], of[4]["host"]) == ("", "", "") and of[5]["rule"] == "example.com/de/" and of[None]["rule"] == "net/"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_neighbours_odd(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.0]), (2, [0.1, 1.0]), (None, [1.0, 1.0]), (3, []), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (100, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "vec", "part", "key", "asks", "score"):
        df = df.withColumn(name, F.lit("c"))
    got = sorted(map(tuple, ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()))
    # of the query id 50 the smaller vector (0, 1) asks
    assert [(q, i) for q, _, i, _ in got] == [(50, 2), (50, 100), (50, 1), (100, 1), (100, 2), (100, 50)]
    assert got[0][3] == pytest.approx(1 / np.sqrt(1.01)) and got[3][3] == pytest.approx(1.1 / np.sqrt(2 * 1.01))
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_html_odd(spark):
    page = "<article><h1>Title of it</h1><p>" + "long words here and there " * 20_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, "plain text"), (2, "u", "<<<>>> &#x0; &bogus; <p")], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html.extract(df).collect()
    assert len(got) == 4 and got[0]["text"] == got[1]["text"] == "Title of it\n\n" + ("long words here and there " * 20_000).strip()
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] is None] == ["plain text"]
    assert html.extract(df.limit(0)).count() == 0


def test_html_layouts_that_the_training_rule_does_not_write():
    """Pages by hand: other tags, names in other languages, tables as layout, markup without end tags."""
    model = html.default_model()
    body = ["A first paragraph that tells what happened in the town on that day, and to whom.", "A second one, which tells why it happened and what the people there say of it."]
    inner = "".join(f"<p>{x}</p>" for x in body)
    pages = [
        f"<body><div id=kopf><a href=/>Start</a> <a href=/2>Zwei</a></div><div id=inhalt>{inner}</div><div id=fuss><a href=/i>Impressum</a></div></body>",
        f"<body><table><tr><td><a href=/>One</a><br><a href=/2>Two</a></td><td>{inner}</td></tr></table></body>",
        f"<body><main><section>{inner}</section></main><footer>Copyright</footer></body>",
        "<body><p>" + "<p>".join(body) + "<ul><li><a href=/a>next</a><li><a href=/b>last</a></ul>",
    ]
    for page in pages:
        got = model.extract([page])[0]
        assert all(x in got for x in body), (page, got)


def test_quality_replaces_columns_of_its_names(spark):
    odd = odd_docs(spark).withColumn("predicted", F.lit("p"))
    model = quality.train(odd, odd.select("doc_id").limit(0).withColumn("quality", F.lit(1)))
    scored = quality.score(odd, model)
    assert scored.columns.count("score") == scored.columns.count("predicted") == 1 and dict(scored.dtypes)["predicted"] == "int"


def test_one_labelled_id_many_times(spark):
    """A repeated labelled document is learned from once."""
    rows = [(1, "good words in a row")] * 50 + [(i, f"bad $$$ {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") == 1).cast("int").alias("quality"), (F.col("doc_id") == 1).cast("int").alias("toxic"))
    assert quality.train(docs, labels, rows=100).constant is None
    assert toxicity.train(docs, labels).weights.shape == (toxicity.FEATURES,)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: what it keeps, by plain Python."""
    import corpus_pipeline

    rng = np.random.default_rng(24)
    good = [" ".join(f"w{x}" for x in rng.integers(0, 300, 50)) + "." for _ in range(80)]
    bench = " ".join(f"zz{i}" for i in range(1, 15))
    texts = [*good, *good[:5], good[7] + " extra", f"{good[9]} {bench}", *["BUY!! $$$ %%% NOW!! " * 5 + str(i) for i in range(30)]]
    docs = frame(spark, texts)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels = docs.select("doc_id", (F.col("doc_id") < 87).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = common.materialize(stages["quality"](spark, docs, d), "t")
    model = quality.train(docs, labels)
    passed = {r["doc_id"] for r in quality.score(docs, model, ["doc_id"]).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in one.collect()} == passed == set(range(87))
    two = common.materialize(stages["near-dedup"](spark, one, d), "t")
    kept = {i for i, (_, c) in brute_duplicates([(i, texts[i]) for i in passed], 5, 80).items() if c == i}
    assert {r["doc_id"] for r in two.collect()} == kept
    three = common.materialize(stages["decontamination"](spark, two, d), "t")
    assert {r["doc_id"] for r in three.collect()} == {i for i in kept if bench not in texts[i]}
    four = common.materialize(stages["mixing"](spark, three, d), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(three, labels).collect() if r["copies"]}
    assert four.groupBy("doc_id").count().count() == len(copies) and four.count() == sum(copies.values())
    five = stages["token output"](spark, four, d).orderBy("start").collect()
    encoder, start = tokens.Encoder(tokens.vocabulary()), 0
    for r, (i, t) in zip(five, sorted((r["doc_id"], r["text"]) for r in four.collect())):
        own = np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(own), zlib.crc32(own))
        start += len(own)
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, five))
