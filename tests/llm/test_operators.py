"""The operators against brute force, round trips, held-out accuracy and odd rows."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import embeddings, jaccard, language, lines, media, mixing, packing, quality, rollups, toxicity, words
from codeloom.llm.bpe import default_path, encoder
from codeloom.llm.labelled import labelled_sample
from codeloom.llm.queries import QUERIES, SQL
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, at string, id string, fp string, rep long"
LONG = " ".join(f"w{i}" for i in range(300_000))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 else "en", None if (i or 0) % 2 else "s", None, "x", "y", "z", 1) for i, t in texts], DOC)


ODD = [(1, None), (2, ""), (3, "   \n \t"), (4, "one two"), (5, "one two"), (5, "one two"), (6, LONG), (7, "a\n\na\n\n"), (None, "lost"), (8, "<|endoftext|> é ß   \x00 z")]


@pytest.fixture(scope="session")
def odd(spark):
    return rows(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return rows(spark, [])


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), duck(SF, SQL[name]))


def test_odd_rows(odd, none):
    n = len(ODD)
    assert media.media_columns(odd).count() == n and media.media_columns(none).count() == 0
    p = language.learn(odd)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, p).collect()}
    assert (1, "und", 0.0) in got and (2, "und", 0.0) in got and len(got) == n - 1
    assert language.identify(none, language.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(none)).collect()} == {"und"}
    d = lines.line_dedup(odd)
    assert d.count() == n and d.columns == [*odd.columns, "n_lines", "n_deleted"]
    assert sorted(str(r["text"]) for r in d.collect()) == sorted(str(t) for _, t in ODD)
    assert lines.line_dedup(none).count() == 0
    c = {r["doc_id"]: r for r in jaccard.similar_classes(odd).collect()}
    assert c[5]["component_id"] == 4 and c[1]["n_shingles"] == 0 and c[6]["n_shingles"] == 299_996 and c[None]["component_id"] is None
    assert jaccard.similar_classes(odd).count() == n and jaccard.similar_classes(none).count() == 0
    m = mixing.draws(odd)
    assert m.where("tokens = 0").count() == 0 and mixing.draws(none).count() == 0
    assert rollups.counted(none).count() == 0 and rollups.counted(odd).count() == n


def test_classifiers_on_odd_rows(spark, odd, none):
    marks = [(2, 0, 1, "x"), (3, 1, 0, "x"), (4, 1, 0, "x"), (5, 0, 1, None), (5, 1, None, "x"), (None, 1, 1, "x"), (7, None, None, "x"), (99, 0, 0, "x"), (6, 1, 0, "x"), (8, 0, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    clashing = odd.withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "label": F.lit("l")})
    for docs, n in ((clashing, len(ODD)), (none, 0)):
        for have in (labels, labels.limit(0)):
            got = quality.score(docs, quality.learn(docs, have)).collect()
            bad = toxicity.score(docs, toxicity.train(labelled_sample(docs, have, "toxic"))).collect()
            for found in (got, bad):
                assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
                assert len({(r["score"], r["predicted"]) for r in found if r["doc_id"] == 5}) <= 1


def test_word_hashes():
    texts = [b"", b" ", b"Abc aBC\tabd\n", b"x" * 3_000_000 + b" y", "é É".encode()] + [b"p q r"] * 3
    got = list(words.word_hashes(texts))
    assert [x.size for x in got] == [0, 0, 3, 2, 2, 3, 3, 3]
    assert got[2][0] == got[2][1] != got[2][2] and (got[5] == got[7]).all()
    rng = np.random.default_rng(1)
    many = [bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(20000)]
    h = next(words.word_hashes([b" ".join(many)]))
    assert len(set(h.tolist())) == len(set(many))


def test_png():
    rng = np.random.default_rng(2)
    for raw in (b"", b"a", bytes(64), rng.integers(0, 256, 6400, dtype=np.uint8).tobytes(), b"abc " * 999):
        pay = media.pad(raw)
        png = media.encode(pay)
        assert media.decode(png).tobytes() == pay and len(pay) % 64 == 0 and pay
        for at in (0, 20, len(png) // 2, len(png) - 6):
            bad = bytearray(png)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                media.decode(bytes(bad))
    x = rng.integers(0, 256, (5, 8), dtype=np.uint8).astype(int)
    got = np.zeros((5, 9), np.uint8)
    for r in range(5):  # one row for each filter
        for i in range(8):
            a, b, c = (x[r, i - 1] if i else 0), (x[r - 1, i] if r else 0), (x[r - 1, i - 1] if r and i else 0)
            g = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(g - v))
            got[r, 0], got[r, 1 + i] = r, (x[r, i] - (0, a, b, (a + b) // 2, paeth)[r]) % 256
    assert (media.unfilter(got) == x).all()


def brute_classes(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for g in sets[i] for j in holders[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(spark):
    """Groups of edited copies around the threshold, over a passage that most texts share."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage, texts, i = [word() for _ in range(60)], {}, 0
    for g in range(40):
        base = [word() for _ in range(int(rng.integers(3, 150)))]
        if g % 2:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        for _ in range(int(rng.integers(1, 40))):
            t = list(base)
            for _ in range(int(rng.integers(0, 6))):
                t[int(rng.integers(0, len(t)))] = word()
            texts[i] = " ".join(t).title()
            i += 1
    want = brute_classes(texts)
    old = jaccard.frequent_class
    for least in (4, 48):
        jaccard.frequent_class = lambda c, n=least: old(c, n)
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(rows(spark, texts.items())).collect()}
        finally:
            jaccard.frequent_class = old
        assert got == want


def test_jaccard_signatures():
    """Similar sets share a signature whatever tokens are called frequent."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(x.size) > 0.08], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64))))
        c = np.intersect1d(x, y).size
        if 100 * c < 80 * (x.size + y.size - c) or x.size == y.size == c:
            continue
        every = np.union1d(x, y)
        f = np.sort(every[rng.random(every.size) < rng.random()])
        a, b = (jaccard.signatures(s, f)[0] for s in (x, y))
        assert np.intersect1d(a, b).size


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    data, i = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            c = rng.normal(size=8)
            for _ in range(int(rng.integers(1, 12))):
                data.append((i, [float(v) for v in c + 0.08 * rng.normal(size=8)], label, 1))
                i += 1
    data += [(i + k, v, 0, 1) for k, v in enumerate(([0.0] * 8, None, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, None] * 4, data[0][1], data[0][1], [2 * v for v in data[0][1]]))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n long")
    for chunk in (16, 1024):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
        assert len(got) == len(data)
        good = [d for d in data if d[2] is not None and d[1] and None not in d[1] and np.isfinite(d[1]).all() and any(d[1])]
        near = collections.defaultdict(set)
        for a in good:
            for b in good:
                x, y = np.array(a[1]), np.array(b[1])
                if a[0] != b[0] and a[2] == b[2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    near[a[0]].add(b[0])
        for d in data:
            seen, todo = {d[0]}, [d[0]]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            r = got[d[0]]
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(near[d[0]]), min(seen), min(seen) == d[0])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_packing(odd, none):
    parts = packing.pieces(odd, most=64, keep_ids=True).cache()
    placed = packing.pack(parts, 64, 16).collect()
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in placed:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for s in by_seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    for i, t in ODD:
        want = encoder(default_path()).full.encode(t or "", add_special_tokens=False).ids + [0]
        copies = sum(j == i for j, _ in ODD)
        got = sorted(by_doc[i], key=lambda r: r["piece"])[:: copies]
        ids = [x for r in got for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()]
        assert ids == want and [r["start"] for r in got] == np.cumsum([0, *[r["length"] for r in got]])[:-1].tolist()
        assert all(r["length"] == 64 for r in got[1:])
    assert packing.pack(packing.pieces(none)).count() == 0
    spaces = " " * 100_000 + "x"
    e = encoder(default_path())
    assert e.ids(spaces).tolist() == e.full.encode(spaces, add_special_tokens=False).ids


def test_packing_does_not_depend_on_the_tasks(spark):
    parts = spark.createDataFrame([(i, 0, 1 + i * 7 % 60) for i in range(500)], "doc_id long, piece int, length long").cache()
    got = [sorted(map(tuple, packing.pack(parts, 64, 16, group_rows=50, most_tasks=n).collect())) for n in (1, 3, 100)]
    assert got[0] == got[1] == got[2] and len({r[3] >> 32 for r in got[0]}) == 10


def test_packer_is_best_fit():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 9, 4, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 9)]
    assert p.n_open == 0
    p = packing.Packer(10, 2)
    assert [p.place(n)[0] for n in (5, 6, 7, 5)] == [0, 1, 2, 0]  # the bin with 6 was the fullest, and closed


def test_rollups(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path))
    assert r.totals().count() == 0
    c = spark.createDataFrame([("a", "en", 5, 7), ("a", "en", 3, 3), (None, None, None, 2)], "source string, lang string, old long, new long")
    assert r.commit("b1", rollups.inserts(c, "v1", "old")) and not r.commit("b1", rollups.inserts(c, "v1", "old"))
    get = lambda: {(x["source"], x["lang"]): (x["docs"], x["tokens"]) for x in r.totals().collect()}
    assert get() == {("a", "en"): (2, 8), (None, None): (1, 0)}
    (tmp_path / "batch=b2").mkdir()
    (tmp_path / "batch=b2" / "part-0.parquet").write_bytes(b"broken off")
    assert get()[("a", "en")] == (2, 8)
    assert r.commit("b2", rollups.revisions(c, "v1", "old", "new")) and get() == {("a", "en"): (2, 10), (None, None): (1, 2)}
    r.commit("b3", rollups.deletes(c, "v1", "new"))
    assert get() == {}


def test_quality_and_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op2_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.93
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op9_language_id"](spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.97


def test_models_without_labels():
    assert quality.Network(3).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.Network(3).fit(np.zeros((3, 3)), np.ones(3)).scores(np.zeros((1, 3)))[0] == 0.8
    assert toxicity.Model(np.empty(0, np.uint64)).scores([b"x"])[0] == 0.5


def test_counterfactuals_cut_false_positives():
    """A group named mostly in toxic texts: its neutral mention must not count."""
    rng = np.random.default_rng(6)
    plain = [f"n{k}" for k in range(40)]
    texts, y = [], []
    for k in range(400):
        toxic = k % 4 == 0
        t = list(rng.choice(plain, 8)) + (["vile"] if toxic and k % 8 else []) + (["women"] if toxic or k % 50 == 1 else [])
        texts.append(" ".join(t).encode())
        y.append(float(toxic))
    vocabulary = np.unique(np.concatenate([*toxicity.features([b" ".join(texts)]), *toxicity.features([t.encode() for t in toxicity.IDENTITY_TERMS])]))
    neutral = [b"n1 women n2", b"n3 women n4 n5"]
    score = []
    for swap in (0.0, 20.0):
        m = toxicity.Model(vocabulary)
        m.fit([m.positions(h) for h in toxicity.features(texts)], np.array(y), swap=swap)
        score.append(m.scores(neutral).max())
    assert score[0] > 0.5 > score[1]


def test_line_runs(spark):
    run = "\n".join(f"line number {k} of a run" for k in range(4))
    one = " ".join(f"long{k}" for k in range(60))
    d = rows(spark, [(1, f"a\n{run}\nb"), (2, f"c\n\n{run}\nd"), (3, one), (4, f"e\n{one}"), (5, "a\nb"), (6, "a\nb")])
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in lines.line_dedup(d).collect()}
    assert got == {1: (f"a\n{run}\nb", 0), 2: ("c\n\nd", 4), 3: (one, 0), 4: ("e", 1), 5: ("a\nb", 0), 6: ("a\nb", 0)}


def test_mixing_reaches_its_target(spark):
    d = spark.createDataFrame([(i, " ".join(["w"] * 20), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 90 + ["low"] * 10)], "doc_id long, text string, source string")
    n = collections.Counter(r["source"] for r in mixing.draws(d, target_entropy=0.9, max_repeats=1000).collect())
    p = np.array(list(n.values())) / sum(n.values())
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.9) < 0.02 and abs(sum(n.values()) - 1000) <= 3
    n = collections.Counter(r["doc_id"] for r in mixing.draws(d, target_entropy=1.0, max_repeats=4).collect())
    assert max(n.values()) <= 4


def test_line_runs_in_a_long_document(spark):
    """Cost grows with the lines, not with lines x deleted lines."""
    run = "\n".join(f"row {k}" for k in range(60_000))
    d = rows(spark, [(1, run), (2, f"first\n{run}\nlast\n")])
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_deleted"]) for r in lines.line_dedup(d).collect()}
    assert got == {1: (run, 60_000, 0), 2: ("first\nlast\n", 60_002, 60_000)}


def test_mixing_over_many_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(mixing.draws(docs, block_tokens=50).toPandas(), duck(SF, SQL["op6_source_mixing"].replace("total / 50000", "total / 50")))
