"""Media columns, packing, language profiles and rollups against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import struct
import threading
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import language, media, packing, rollups
from codeloom.llm.bpe import default_path, encoder
from codeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_feature(payload: bytes) -> str:
    """The hash by the definition of the cosine transform, a coefficient at a time."""
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    cosine = lambda n, u, i: round(4096 * math.cos(math.pi * (2 * i + 1) * u / (2 * n)))
    c = []
    for u in range(8):
        column = [sum(cosine(len(rows), u, y) * r[x] for y, r in enumerate(rows)) for x in range(64)]
        c += [sum(column[x] * cosine(64, v, x) for x in range(64)) for v in range(8)]
    median = sorted(c[1:])[31]
    return f"{int(''.join('1' if x > median else '0' for x in c), 2):016x}"


def plain_png(png: bytes) -> bytes:
    """The samples, by zlib and the filters' definitions."""
    at, data = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    assert (width, depth, colour) == (64, 8, 0)
    lines, out, above = zlib.decompress(data), b"", bytes(64)
    for y in range(height):
        kind, line = lines[y * 65], bytearray(lines[y * 65 + 1 : y * 65 + 65])
        for x in range(64):
            line[x] = (line[x] + (0, line[x - 1] if x else 0, above[x])[kind]) & 255
        above = bytes(line)
        out += above
    return out


def test_media_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, "é" * 50_000), (None, "a"), (-4, "x" * 64), (-4, "x" * 64)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("media", F.lit("clash"))
    texts = collections.Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    got = media.media_columns(docs).collect()
    seen = collections.Counter()
    for r in got:
        payload = plain_png(bytes(r["media"]))
        raw = payload[: r["n_bytes"]]
        seen[r["doc_id"], raw] += 1
        assert payload == raw + bytes(len(payload) - len(raw)) and len(payload) % 64 == 0 < len(payload) < len(raw) + 64 + (not raw)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
        if len(payload) < 5000:
            assert r["feature"] == plain_feature(payload)
    assert seen == texts


def plain_packer(lengths: list[int], most: int, open_bins: int) -> tuple[list[tuple[int, int]], int]:
    """Best fit over a list of open bins, and how many were closed before they were full."""
    bins, made, out, closed = [], 0, [], 0
    for n in lengths:
        fits = [b for b in bins if b[1] >= n]
        if fits:
            free = min(b[1] for b in fits)
            b = [b for b in fits if b[1] == free][-1]  # of equally full bins the one that came to it last
            bins.remove(b)
        else:
            if len(bins) == open_bins:
                full = min(b[1] for b in bins)
                bins.remove([b for b in bins if b[1] == full][-1])
                closed += 1
            b, made = (made, most), made + 1
        out.append((b[0], most - b[1]))
        if b[1] > n:
            bins.append((b[0], b[1] - n))
    return out, closed


def test_packing_against_a_plain_simulation(spark):
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    most, open_bins, closed, seen = 2048, 16, 0, 0
    placed = packing.pack(parts, most, open_bins, group_rows=400, window=64).withColumns({"task": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).collect()
    groups = collections.defaultdict(list)
    for r in sorted(placed, key=lambda r: (r["task"], r["row"])):
        groups[r["sequence_id"] >> 32].append(r)
    for g, rows in groups.items():
        want, c = plain_packer([r["length"] for r in rows], most, open_bins)
        assert [(r["sequence_id"] - (g << 32), r["offset"]) for r in rows] == want
        closed, seen = closed + c, seen + len(rows)
    assert closed > 0 and seen == parts.count() and len(groups) > 1
    got = packing.pack(parts).agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert got[0] <= 1.02 * math.ceil(got[1] / most) + 1


def test_production_packing_closes_bins(spark):
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 2049, 20_000)]
    p, closed = packing.Packer(2048, 128), 0
    for at in range(0, len(lengths), 256):
        for n in sorted(lengths[at : at + 256], reverse=True):
            before = p.made - p.n_open
            p.place(n)
            closed += p.made - p.n_open > before
    assert closed > 0 and p.n_open <= 128 and p.made <= 1.03 * sum(lengths) / 2048


def test_repeated_rows_and_null_ids_spread_over_groups(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"), F.lit("x").alias("group"), F.lit(1).alias("offset")).cache()
    got = packing.pack(rows, group_rows=500).collect()
    assert len(got) == 4000 and len({r["sequence_id"] >> 32 for r in got}) > 2 and {r["offset"] for r in got} == {0, 700}
    assert max(collections.Counter(r["sequence_id"] for r in got).values()) == 2


def plain_profiles(rows, size: int) -> dict[str, list[int]]:
    by_lang = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        k, n = language.grams(text)
        by_lang[lang].update(dict(zip(k.tolist(), n.tolist())))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]] for lang, c in by_lang.items()}


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(~language.held_out())
    rows = [(r["text"], r["lang"]) for r in docs.collect() if r["text"] is not None and r["lang"] is not None]
    want = plain_profiles(rows, 300)
    got = language.learn(docs)
    assert got.langs == sorted(want)
    for i, lang in enumerate(got.langs):
        ranks = {int(g): int(r) for g, r in zip(got.keys, got.ranks[i]) if r >= 0}
        assert [g for g, _ in sorted(ranks.items(), key=lambda x: x[1])] == want[lang]
    for text, _ in rows[:60]:
        k, n = language.grams(text)
        mine = [g for g, _ in sorted(zip(k.tolist(), n.tolist()), key=lambda x: (-x[1], x[0]))[:300]]
        far = {lang: sum(min(300, abs(p.index(g) - i)) if g in p else 300 for i, g in enumerate(mine)) for lang, p in want.items()}
        assert got.predict(text)[0] == min(sorted(far), key=far.get)


def test_token_counts_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    want, e = collections.Counter(), encoder(default_path())
    for r in docs:
        if r["doc_id"] in bad:
            continue
        text = r["text"] or ""
        words = text.translate(str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))).split(" ")
        for version, n in (("words-1", sum(map(bool, words))), ("byte_bpe_50k", len(e.full.encode(text, add_special_tokens=False).ids) + 1)):
            want[r["source"], r["lang"], version, "docs"] += 1
            want[r["source"], r["lang"], version, "tokens"] += n
    got = {(r["source"], r["lang"], r["tokenizer_version"], k): r[k] for r in QUERIES["op10_token_counts"](spark, SF).collect() for k in ("docs", "tokens")}
    assert got == {k: v for k, v in want.items() if v}


def change(spark, n: int):
    return rollups.inserts(spark.createDataFrame([("s", "en", n)], "source string, lang string, n long"), "v", "n")


def test_one_of_many_writers_commits_a_batch(spark, tmp_path):
    r, added = rollups.Rollup(spark, str(tmp_path)), []
    writers = [threading.Thread(target=lambda k=k: added.append(r.commit("same", change(spark, k)))) for k in range(1, 7)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(added) == [False] * 5 + [True] and r.batches() == ["same"]
    assert [x["docs"] for x in r.totals().collect()] == [1] and not [n for n in r._names("staging-")]


def test_totals_read_the_snapshot_and_what_came_after(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path), fold_after=3)
    for k in range(1, 9):
        assert r.commit(f"b{k}", change(spark, k)) and not r.commit(f"b{k}", change(spark, 100))
        got = r.totals().first()
        assert (got["docs"], got["tokens"]) == (k, k * (k + 1) // 2)
        assert len(r._after(r._latest())) < 3
    assert r._latest() == "000000000002" and len(r.batches()) == 8
    assert not (tmp_path / "batch=b1" / "sums").exists() and not r.commit("b1", change(spark, 1))
    assert r.fold() and not r.fold() and r.totals().first()["tokens"] == 36
    assert not r.commit("b8", change(spark, 1)) and r.totals().first()["tokens"] == 36


def test_empty_batches_and_null_keys(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path), fold_after=1)
    assert r.commit("none", change(spark, 1).limit(0)) and r.totals().count() == 0
    c = spark.createDataFrame([(None, None, None), (None, "", 3), (None, "", 3)], "source string, lang string, n long").withColumn("docs", F.lit("clash"))
    assert r.commit("odd", rollups.inserts(c, "v", "n"))
    assert {(x["source"], x["lang"]): (x["docs"], x["tokens"]) for x in r.totals().collect()} == {(None, None): (1, 0), (None, ""): (2, 6)}
