"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct five-word shingles, as 64-bit hashes. Identical sets collapse first.
Tokens that many documents share form the frequent class; all others, in the order of their hashes, come
before them. A set of n tokens at similarity t misses at most n - ceil(t n) tokens of a partner, so its
prefix is the shortest that survives that many losses:

- a rare token is a signature by itself;
- frequent tokens fall into sub-classes, and each pair of prefix tokens of one sub-class is a signature.
  A sub-class of c tokens has a common pair left unless c - 1 of them are lost, so the prefix is extended
  by one token per sub-class. The number of sub-classes follows the size of the set; a set signs for its
  own size class and the next, so that any two sets within the size ratio share one.

Two sets at or above the threshold share a signature (both prefixes end at known ranks, and the shorter
prefix loses too few tokens to break all its signatures). Each prefix is extended by a twentieth of its set
beyond that, so similar sets share that many signatures more; a set that shares fewer with all others
together has no partner and leaves before any text is compared. Short posting lists give pairs, which counts of
shared signatures thin out. A long list gives its members to the group of its leader, the member with the
least mixed id, so that the many like lists of a group of copies fall into few groups. All pairs of a
group are then verified on the whole texts, block against block, and leave a spanning forest: no pair is
left out and none becomes a row. Frequent classes only steer cost: whatever they hold, the result is exact.

Memory: postings travel in packed arrays by hash bucket, whose number follows the number of tokens, and are
worked on bucket by bucket; verification holds two blocks of sets. A group of g different texts costs
(g / block)^2 / 2 units, and each of its texts travels g / block times.

Defined results: a null text counts as empty; a text without words has an empty set and links with
nothing; a text of fewer than five words has its whole word sequence as its one shingle; repeated rows of
one id are one member; rows with a null id never link, each is its own class with a null component; an
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import saved, shuffle_partitions, table
from codeloom.llm.graph import connected_components
from codeloom.llm.words import U, mix, utf8, word_hashes

WIDTH = 5
_K = U(0xD6E8FEB86659FD93)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words.size:
        return words
    n = max(1, words.size - width + 1)
    h = np.zeros(n, U)
    for k in range(min(width, words.size)):
        h = h * _K + words[k : k + n]
    return np.unique(mix(h + U(min(width, words.size))))


def fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if s.size else b""


def set_id(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "big", signed=True)


def _size_classes(limit: int = 1 << 40) -> np.ndarray:
    """Class limits: sizes within 5/4 of each other lie in one class or two neighbours."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


_CLASSES = _size_classes()


def lost(n: int, percent: int) -> int:
    """Tokens that a set of n may lack in a partner of that similarity."""
    return n - (-(-percent * n // 100))


#: A prefix is extended by n // EXTRA tokens, so that similar sets share as many more signatures.
EXTRA = 20


def _rare(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ U(0x5851F42D4C957F2D))


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = 80) -> tuple[np.ndarray, int]:
    """Signatures of a set, and how many of the first ones are all its rare tokens, where its prefix
    goes beyond them (else 0). frequent: sorted tokens of the frequent class."""
    n = s.size
    if n < 2:
        return np.empty(0, U), 0  # such a set's only partners are identical
    need = lost(n, percent) + 1 + n // EXTRA
    at = np.searchsorted(frequent, s)
    known = np.zeros(n, bool) if not frequent.size else frequent[np.minimum(at, frequent.size - 1)] == s
    rare, often = s[~known], s[known]
    if rare.size >= need:
        return _rare(rare[:need]), 0
    need -= rare.size
    out, own = [_rare(rare)], int(np.searchsorted(_CLASSES, n, side="right")) - 1
    for label in (own, own + 1):
        groups = U(max(1, int(_CLASSES[label]) // 20))
        sub = (mix(often + U(77)) % groups).astype(np.int64)
        first = np.zeros(often.size, bool)
        first[np.unique(sub, return_index=True)[1]] = True
        got = np.cumsum(~first)
        stop = int(np.searchsorted(got, need)) + 1 if got.size and got[-1] >= need else often.size
        order = np.argsort(sub[:stop], kind="stable")
        a, g = often[:stop][order], sub[:stop][order]
        for d in range(1, stop):
            same = g[d:] == g[:-d]
            if not same.any():
                break
            out.append(mix(mix(a[:-d][same] + U(label)) * _K + a[d:][same]))
    return np.concatenate(out), rare.size


def document_sets(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, fp) of each row, and (token, n): tokens that came often within one block of documents."""
    import pyarrow as pa

    def run(batches):
        seen, held, size = set(), [], 0

        def often():
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, U), np.empty(0, int))
            keep = n >= 3
            h, n = h[keep], n[keep]
            return pa.RecordBatch.from_arrays([pa.nulls(h.size, pa.int64()), pa.array(n.astype(np.int64)), pa.nulls(h.size, pa.binary()), pa.array(h.view(np.int64))], names=["doc_id", "n", "fp", "token"])

        for b in batches:
            ns, fps = [], []
            for words in word_hashes(utf8(b.column(1))):
                s = shingle_set(words)
                fp = fingerprint(s)
                ns.append(s.size)
                fps.append(fp)
                if fp not in seen and s.size > 1:
                    seen.add(fp)
                    held.append(s)
                    size += s.size
                if size > 2_000_000:
                    yield often()
                    held.clear()
                    seen.clear()
                    size = 0
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.nulls(len(ns), pa.int64())], names=["doc_id", "n", "fp", "token"])
        yield often()

    rows = saved(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, fp binary, token long"), "sets")
    return rows.where("token is null").select("doc_id", "n", "fp"), rows.where("token is not null").select("token", "n")


def frequent_class(counts: DataFrame, least: int = 48, most: int = 1 << 17) -> np.ndarray:
    """At most `most` tokens (a megabyte): the commonest, from a least count."""
    rows = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(U))


def postings(docs: DataFrame, key: str, text: str, frequent: np.ndarray, percent: int, buckets: int = 512) -> DataFrame:
    """(bucket, sigs, ids, sizes): packed signatures of the sets, by bucket; within a task each distinct set once.

    A set's id is the first half of its fingerprint. A size is negative where the signature is one of all
    rare tokens of a set.
    """
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by frequent_class

    def run(batches):
        seen: set[bytes] = set()
        sigs, ids, sizes, size = [], [], [], 0

        def out():
            if not sigs:
                return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=["bucket", "sigs", "ids", "sizes"])
            n = [x.size for x in sigs]
            s, d, z = np.concatenate(sigs), np.repeat(np.array(ids, np.int64), n), np.concatenate(sizes)
            bucket = (s % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            s, d, z, bucket = s[order], d[order], z[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], s.size)
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *(pa.array([x[a:e].tobytes() for a, e in zip(cuts, ends)], pa.binary()) for x in (s, d, z))], names=["bucket", "sigs", "ids", "sizes"])

        for b in batches:
            for i, words in zip(b.column(0).to_pylist(), word_hashes(utf8(b.column(1)))):
                s = shingle_set(words)
                if i is None or s.size < 2:
                    continue
                fp = fingerprint(s)
                if fp in seen:
                    continue
                seen.add(fp)
                got, rare = signatures(s, held.value, percent)
                n = np.full(got.size, min(s.size, 2**31 - 1), np.int32)
                n[:rare] *= -1
                sigs.append(got)
                ids.append(set_id(fp))
                sizes.append(n)
                size += sigs[-1].size
                if size > 1_000_000:
                    yield out()
                    sigs, ids, sizes, size = [], [], [], 0
        yield out()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "bucket int, sigs binary, ids binary, sizes binary")


def candidates(packed: DataFrame, percent: int, short: int = 8, most: int = 4_000_000) -> DataFrame:
    """Rows (kind, a, b, n). 0: sets a and b share n signatures of short lists; 1: b is in a long list led
    by a; 2: a has n signatures in long lists; 3: n of the rare tokens of a are in no other set's prefix;
    4: a has n signatures in short lists of two or more."""
    import pyarrow as pa

    dealt = packed.repartition(shuffle_partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")

    def run(batches):
        """Bucket by bucket: what is held is one bucket's postings and, up to `most`, rows that may still add up."""
        kinds: list[list[np.ndarray]] = [[], [], [], [], []]

        def summed(rows: list[np.ndarray]) -> list[np.ndarray]:
            """Rows (a, b, n) with n summed by (a, b)."""
            x = np.concatenate(rows)
            order = np.lexsort((x[:, 1], x[:, 0]))
            x = x[order]
            fresh = np.ones(len(x), bool)
            fresh[1:] = (x[1:, :2] != x[:-1, :2]).any(axis=1)
            at = np.flatnonzero(fresh)
            return [np.column_stack((x[at, :2], np.add.reduceat(x[:, 2], at)))] if at.size else [x]

        def rows(a, b):
            return np.column_stack((a, b, np.ones(a.size, np.int64)))

        def bucket(parts: list) -> None:
            s, d, z = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((mix(d.view(U)), s))  # a list's leader: the least mixed id
            s, d, z = s[order], d[order], z[order]
            fresh = np.ones(s.size, bool)
            fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            s, d, z = s[fresh], d[fresh], z[fresh]
            cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            count = np.append(cuts[1:], s.size) - cuts
            alone = d[cuts[(count == 1) & (z[cuts] < 0)]]
            kinds[3].append(rows(alone, np.zeros_like(alone)))
            z = np.abs(z).astype(np.int64)
            lists = np.repeat(np.arange(cuts.size), count)
            few = np.flatnonzero(((count > 1) & (count <= short))[lists])
            kinds[4].append(rows(d[few], np.zeros_like(d[few])))
            for step in range(1, short):
                x = few[few + step < s.size]
                x = x[lists[x + step] == lists[x]]
                y = x + step
                near = percent * np.maximum(z[x], z[y]) <= 100 * np.minimum(z[x], z[y])
                kinds[0].append(rows(np.minimum(d[x], d[y])[near], np.maximum(d[x], d[y])[near]))
            many = np.flatnonzero((count > short)[lists])
            kinds[1].append(rows(d[cuts[lists[many]]], d[many]))
            kinds[2].append(rows(d[many], np.zeros_like(d[many])))
            kinds[:] = [summed(x) for x in kinds]

        def out():
            for kind, x in enumerate(kinds):
                for y in x:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), kind, np.int32)), *(pa.array(np.ascontiguousarray(y[:, c])) for c in range(3))], names=["kind", "a", "b", "n"])
            kinds[:] = [[], [], [], [], []]

        at, held = None, []
        for b in batches:
            for k, s, d, z in zip(*(c.to_pylist() for c in b.columns)):
                if k != at:
                    if held:
                        bucket(held)
                    if sum(len(y) for x in kinds for y in x) > most:
                        yield from out()
                    at, held = k, []
                held.append((np.frombuffer(s, U), np.frombuffer(d, np.int64), np.frombuffer(z, np.int32)))
        if held:
            bucket(held)
        yield from out()

    rows = dealt.mapInArrow(run, "kind int, a long, b long, n long")
    return saved(rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "candidates")


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs that are similar enough, by the product of set-token matrices."""
    size = np.array([s.size for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=token.size) > 1
    keep = shared[at]
    at, who = (np.cumsum(shared) - 1)[at[keep]], who[keep]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    common, step = np.zeros((len(sets), len(sets))), 2048  # a step's counts fit 32-bit floats, their sums need 64
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(at, (lo, lo + step))
        m = np.zeros((len(sets), step), np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        common += m @ m.T
    c = common.astype(np.int64)
    x, y = np.nonzero(np.triu((100 * c >= percent * (size[:, None] + size[None, :] - c)) & (c > 0), 1))
    return x, y


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    root, out = list(range(n)), []
    for a, b in zip(x.tolist(), y.tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def verified(groups: DataFrame, docs: DataFrame, key: str, text: str, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) that connect whatever pairs of a group's members are similar enough.

    groups: distinct (lead, id). A group of more than `block` members is compared block against block,
    each pair of blocks a task's unit of work, on the whole texts.
    """
    import pyarrow as pa

    spark = groups.sparkSession
    size = groups.groupBy("lead").agg(F.count("*").alias("members")).where("members > 1")
    size = saved(size.select("lead", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "sizes")
    mine = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    wanted = groups.join(size, "lead").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wanted = saved(wanted.select("id", "lead", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")), "wanted")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    rows = wanted.hint("merge").join(texts, "id").select("lead", "lo", "hi", "id", "text")
    dealt = rows.repartition(shuffle_partitions(spark), "lead", "lo", "hi").sortWithinPartitions("lead", "lo", "hi")

    def run(batches):
        at, ids, sets = None, [], []

        def out():
            links = []
            if len(sets) > 1:
                links = _forest(len(sets), *similar_pairs(sets, percent))
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.int64()), pa.array([ids[b] for _, b in links], pa.int64())], names=["a", "b"])

        for b in batches:
            names = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            for name, i, words in zip(names, b.column(3).to_pylist(), word_hashes(utf8(b.column(4)))):
                if name != at:
                    yield out()
                    at, ids, sets = name, [], []
                ids.append(i)
                sets.append(shingle_set(words))
        yield out()

    return saved(dealt.mapInArrow(run, "a long, b long").where("a != b"), "links")


def _bounds(percent: int) -> str:
    """What a pair of short lists must satisfy to be similar.

    The set whose prefix ends first shares all its signatures with the other but for as many as the tokens
    that the pair may miss can break. Where both prefixes go beyond the rare tokens (`beyond`; known of sets
    that have such tokens to themselves), no more tokens can be common than either set has besides those.
    """
    common = f"ceil({percent} * (nx + ny) / {100 + percent})"
    x, y = (f"(n{k} - ceil({percent} * n{k} / 100) + 1 + n{k} div {EXTRA} - (n{k} - {common}))" for k in "xy")
    free = f"{100 + percent} * least(nx - alonex, ny - aloney) >= {percent} * (nx + ny)"
    return f"shared + least(longx, longy) >= least({x}, {y}) and (not (beyondx and beyondy) or {free})"


def _hopeful(percent: int) -> str:
    """What a set must satisfy to have any partner: enough shared signatures, and tokens that others may hold."""
    return f"long + short > (ceil({percent} * n / 100) div {EXTRA}) and (not beyond or 100 * (n - alone) >= {percent} * n)"


def similar_classes(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sets, counts = document_sets(docs, key, text)
    frequent = frequent_class(counts)
    firsts = saved(sets.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "sets")
    tokens = firsts.agg(F.sum("n")).first()[0] or 0  # a bucket has about a million signatures, of a quarter of the tokens
    found = candidates(postings(docs, key, text, frequent, percent, max(512, tokens // 4_000_000)), percent)
    ids = firsts.select(F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("long").alias("id"), "rep", "n")
    for kind, name in ((2, "long"), (3, "alone"), (4, "short")):
        ids = ids.join(found.where(f"kind = {kind}").select(F.col("a").alias("id"), F.col("n").alias(name)), "id", "left")
    ids = saved(ids.select("id", "rep", "n", F.coalesce("long", F.lit(0)).alias("long"), F.coalesce("short", F.lit(0)).alias("short"), F.coalesce("alone", F.lit(0)).alias("alone"), F.col("alone").isNotNull().alias("beyond")).where(_hopeful(percent)), "ids")
    x, y = (ids.select(*(F.col(c).alias(c + k) for c in ids.columns)) for k in "xy")
    pairs = found.where("kind = 0").select(F.col("a").alias("idx"), F.col("b").alias("idy"), F.col("n").alias("shared")).join(x, "idx").join(y, "idy")
    pairs = pairs.where(f"repx != repy and {_bounds(percent)}").select(F.col("repx").alias("lead"), F.explode(F.array("repx", "repy")).alias("id"))
    reps = ids.select("id", "rep")
    lists = found.where("kind = 1").select(F.col("a").alias("lead"), F.col("b").alias("id")).join(reps, "id").select("lead", F.col("rep").alias("id"))
    groups = saved(pairs.union(lists).distinct(), "groups")
    classes = connected_components(verified(groups, docs, key, text, percent))
    of_set = saved(firsts.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("class")), "classes")
    out = sets.join(of_set, "fp", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return similar_classes(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                                      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from worded
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as l, b.doc_id as r, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select l, r from shared join sizes x on x.doc_id = l join sizes y on y.doc_id = r where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), edges as (
  select l, r from links union all select r, l from links
), reached as (
  select doc_id as l, doc_id as r from documents union select reached.l, edges.r from reached join edges on reached.r = edges.l
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join (select l, min(r) as component_id from reached group by l) c on c.l = d.doc_id
"""
