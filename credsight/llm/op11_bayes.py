"""MinHash near-dedup with sequential Bayesian verification.

A document is the set of its four-word shingles; words are the runs of
characters other than space and U+0009-U+000D, A-Z lower-cased; a text of fewer
words is one shingle.  Documents are linked where
``100 * intersection >= percent * union``; a group is a connected component.

1. Documents of equal sets are one *class* (128-bit print of the set).
2. Classes meet in the buckets of ``bands`` MinHash bands; buckets with the same
   members are kept once.
3. In a *leader* round every member whose component is not its leader's is compared
   with the bucket's leader: one row per member, never pairs of members.  Links
   merge components; a bucket whose members are all of one component is finished.
   Leader rounds go on while a bucket has more than ``REST`` members outside its
   largest component, ``LEADERS`` at most.  What is left is compared whole: the
   members outside the largest component, in blocks of ``BLOCK``, with all members,
   in salted runs of ``RUN``.  Pairs of one component are skipped, they cannot
   change a component; a task emits a link only where it connects two components.
4. A compared pair is first *screened*: its 8-bit signatures (hashes other than
   the bands') are compared in batches of ``STEP``; after every batch the pair is
   dropped if the posterior probability that its similarity reaches the threshold,
   given the matches so far and a uniform prior, is below ``MISS``.  Survivors are
   verified on the full shingle sets; in the last round these travel only for
   members of surviving pairs.
5. Components come from contraction: every node points to the neighbour that comes
   first, the links are renamed, loops and repeats go, until none is left.  The
   order is that of the prints, then of hashes, another one after every ``SAME``
   steps: links are mostly stars around leaders, and where the order stays, the leaves
   of a star that point past its middle have all met one step later.  Minima are partial aggregates, and they are
   written before they are joined, so that the join of a node with very many links
   can be split at run time.

Missed links: a pair at the threshold shares no band with probability
1 - ``RECALL``, and is dropped by the screen with at most about 6 * ``MISS``.  No
link is reported that the full sets do not confirm.

Texts that are null, empty or without words have the empty set, are linked with
nothing and are all kept.  Repeated rows are documents of one class.  A null
doc_id takes part; it names a component only if no member has an id, and rows of
such a component are all kept.  Empty tables give empty results.  Other columns
are ignored by ``link`` and passed through by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsight.llm.common import U64, HashCache, hash_words, map_arrow, shingles, stored, table

K, PERCENT, RECALL, MAX_ROWS = 4, 80, 0.9999, 160
CHECKS, STEP, MISS = 96, 16, 2e-5
SAME = 3
LEADERS, REST, BLOCK, RUN, HELD = 6, 2048, 256, 256, 4_000_000       # HELD: shingles a job may hold at once
U32 = np.uint32
_CACHE = HashCache()


def text_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []     # bytes: ASCII only
    return shingles(hash_words(ws, _CACHE), K)


def choose_bands(percent: int = PERCENT, recall: float = RECALL, max_rows: int = MAX_ROWS) -> tuple[int, int]:
    """(bands, rows): the most selective bands within ``max_rows`` hashes that reach the recall."""
    best = None
    for rows in range(1, max_rows + 1):
        miss = 1 - (percent / 100) ** rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= max_rows:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_rows is too small for this recall")
    return best


def min_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Per batch the least matches with posterior P(J >= threshold) >= miss.

    8-bit hashes match with probability J + (1 - J) / 256; the prior of J is uniform."""
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    hit = j >= percent / 100
    out = []
    for seen in range(STEP, CHECKS + 1, STEP):
        for m in range(seen + 1):
            log = m * np.log(p) + (seen - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[hit].sum() >= miss * like.sum():
                break
        out.append(m)
    return out


def minhash(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    x = (s >> U64(32)).astype(U32)
    low = np.full(len(mult), np.iinfo(U32).max, U32)
    for a in range(0, len(x), 512):
        np.minimum(low, (mult[:, None] * x[None, a:a + 512]).min(axis=1), out=low)
    return low


def band_hashes(low: np.ndarray, bands: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)     # a bucket belongs to one band
    for row in low.reshape(bands, -1).T:
        h = (h ^ row.astype(U64)) * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(29)
    return h.view(np.int64)


def check_bytes(low: np.ndarray) -> bytes:
    x = (low.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9) >> U64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, n, fp, bands, sig): ``th`` is a hash of the text, ``fp`` the print of the set."""
    mult = np.random.default_rng(11).integers(1, 1 << 31, bands * rows + CHECKS).astype(U32) * U32(2) + U32(1)

    def run(batch: pa.RecordBatch) -> dict:
        n, fp, bh, sig = [], [], [], []
        for t in batch.column(1):
            s = text_set(t.as_py())
            n.append(len(s))
            fp.append(xxhash.xxh3_128_digest(s.tobytes()))
            low = minhash(s, mult)
            bh.append(band_hashes(low[:bands * rows], bands) if len(s) else [])
            sig.append(check_bytes(low[bands * rows:]))
        return {"doc_id": batch.column(0), "th": batch.column(2), "n": n, "fp": fp, "bands": bh, "sig": sig}

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return map_arrow(d, run, T.StructType([d.schema["doc_id"], *T._parse_datatype_string(
        "th long, n long, fp binary, bands array<bigint>, sig binary").fields]))


class Side:
    """Members of a job in arrays."""

    def __init__(self, rows: list[tuple]):
        self.fp = [r[0] for r in rows]
        self.comp = [r[1] for r in rows]
        self.root = np.array([int.from_bytes(r[1][:8], "big") for r in rows], U64)
        self.root2 = np.array([int.from_bytes(r[1][8:], "big") for r in rows], U64)
        self.rest = np.array([r[2] for r in rows], bool)
        self.n = np.array([r[3] for r in rows], np.int64)
        self.sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), CHECKS)
        self.order = np.array([int.from_bytes(r[0][:8], "big") for r in rows], U64)
        self.sets = [r[5] for r in rows] if len(rows[0]) > 5 else None


def screen(a: Side, b: Side, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different components that pass the length filter and every batch of signatures."""
    i, j = np.nonzero(((a.root[:, None] != b.root[None, :]) | (a.root2[:, None] != b.root2[None, :]))
                      # two members outside the largest component meet in both their blocks: count one
                      & ~(b.rest[None, :] & (a.order[:, None] > b.order[None, :])))
    small, large = np.minimum(a.n[i], b.n[j]), np.maximum(a.n[i], b.n[j])
    ok = 100 * small >= percent * large
    i, j = i[ok], j[ok]
    m = np.zeros(len(i), np.int64)
    for step, low in enumerate(least):
        if not len(i):
            break
        cut = slice(step * STEP, (step + 1) * STEP)
        m += np.count_nonzero(a.sig[i, cut] == b.sig[j, cut], axis=1)
        ok = m >= low
        i, j, m = i[ok], j[ok], m[ok]
    return i, j


class Merged:
    """Components of a job's members while it runs: a pair that is connected already is not verified."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def confirm(a: Side, b: Side, i: np.ndarray, j: np.ndarray, percent: int, merged: Merged) -> list[tuple[bytes, bytes]]:
    """Pairs that the full sets confirm, of those that connect two components: at most
    one fewer than there are members in the job."""
    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        u, v = merged.find(a.comp[x]), merged.find(b.comp[y])
        if u == v:
            continue
        s, t = np.frombuffer(a.sets[x], U64), np.frombuffer(b.sets[y], U64)
        c = len(np.intersect1d(s, t, assume_unique=True))
        if 100 * c >= percent * (len(s) + len(t) - c):
            out.append((a.fp[x], b.fp[y]))
            merged.up[u] = v
    return out


def _jobs(rows: DataFrame, percent: int, verify: bool) -> DataFrame:
    """Run the jobs of ``rows`` (job, blk, salt, side, fp, root, rest, n, sig[, set]).

    A job's side 0 (at most about ``BLOCK`` members) is held, its side 1 streamed in
    runs.  Screening returns the members of surviving pairs, verifying the links."""
    least = min_matches(percent)
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "job", "blk", "salt").sortWithinPartitions("job", "blk", "salt", "side", "fp")
    schema = "a binary, b binary" if verify else "job long, blk int, salt int, side int, fp binary, root binary, rest boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kept, flow, size, out, merged = None, [], None, [], 0, [], Merged()

        def compare() -> None:
            nonlocal kept, flow, size
            if held and flow:
                kept = kept or Side(held)
                b = Side(flow)
                i, j = screen(kept, b, least, percent)
                if verify:
                    out.extend(confirm(kept, b, i, j, percent, merged))
                else:
                    hit0.update(i.tolist())
                    out.extend((*at, 1, *flow[y][:3]) for y in np.unique(j).tolist())
            flow, size = [], 0

        def close() -> None:
            compare()
            if not verify:
                out.extend((*at, 0, *held[x][:3]) for x in sorted(hit0))
                hit0.clear()

        hit0: set[int] = set()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for job, blk, salt, side, *member in zip(*cols):
                if (job, blk, salt) != at:
                    if at is not None:
                        close()
                    at, held, kept = (job, blk, salt), [], None
                    merged.up.clear()
                if side == 0:
                    held.append(tuple(member))
                else:
                    flow.append(tuple(member))
                    size += member[3]
                    if len(flow) == BLOCK or size > HELD:
                        compare()
            if len(out) > 5000:
                yield _batch(out, names, verify)
                out.clear()
        if at is not None:
            close()
        yield _batch(out, names, verify)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], verify: bool) -> pa.RecordBatch:
    types = [pa.binary()] * 2 if verify else [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every node of the undirected edges (a, b); the root is some node of the component."""
    spark = edges.sparkSession
    cur, steps = edges.where("a <> b"), []
    while True:
        turn = len(steps) // SAME
        rank = lambda c: F.xxhash64(c, F.lit(turn)) if turn else F.col(c)  # noqa: B023, E731
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("k"), "b")).alias("m"))
        to = stored(spark, first.select("a", F.when(F.col("m.k") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("to")), "op11-to")
        steps.append(to)
        cur = stored(spark, cur.join(to, "a").select("b", F.col("to").alias("x")).join(to.withColumnRenamed("a", "b"), "b")
                     .select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct(), "op11-renamed")
        if cur.isEmpty():
            break
    out = steps.pop().withColumnRenamed("to", "root")
    while steps:
        out = steps.pop().join(out.withColumnRenamed("a", "to"), "to", "left").select("a", F.coalesce("root", "to").alias("root"))
    return stored(spark, out.withColumnRenamed("a", "fp"), "op11-roots")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(h, c, lo, fp, n): members of the buckets of at least two classes, with the least of
    them; of buckets with the same members one."""
    spread = classes.select("fp", "n", F.posexplode("bands").alias("band", "h"))
    # equal buckets are found by count, xor, least and largest member: all of them partial aggregates
    same = spread.groupBy("h", "band").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("c > 1")
    jobs = same.groupBy("c", "x", "lo", "hi").agg(F.min(F.struct("band", "h")).alias("j")).select(F.col("j.h").alias("h"), "c", "lo")
    return spread.select("fp", "n", "h").join(stored(classes.sparkSession, jobs, "op11-buckets"), "h").select("h", "c", "lo", "fp", "n")


def full_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(fp, n, sig, set) of the classes ``need`` (fp, rep_id, th, n, sig): the shingles of their representative."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = d.join(need.withColumnRenamed("th", "want"), (F.col("th") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))

    def run(batch: pa.RecordBatch) -> dict:
        fps, ns, sigs, sets = [], [], [], []
        for fp, n, sig, t in zip(*(c.to_pylist() for c in batch.columns)):
            s = text_set(t).tobytes()
            if xxhash.xxh3_128_digest(s) == fp:          # another text of the same id and hash is not it
                fps.append(fp)
                ns.append(n)
                sigs.append(sig)
                sets.append(s)
        return {"fp": fps, "n": ns, "sig": sigs, "set": sets}

    return map_arrow(rows.select("fp", "n", "sig", "text"), run, "fp binary, n long, sig binary, set binary").dropDuplicates(["fp"])


def _leader_rows(m: DataFrame, turn: int) -> DataFrame:
    """Every member of another component than its bucket's leader, and the leaders."""
    spark = m.sparkSession
    if turn == 0:                                  # every class is a component; the least member leads
        flow = m.where("fp <> lo").withColumns({"leader": F.col("lo"), "l_root": F.col("lo")})
    else:
        lead = m.groupBy("h").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("k"), "fp", "root")).alias("l"),
                                  F.min("root").alias("lo_root"), F.max("root").alias("hi_root")).where("lo_root <> hi_root")
        lead = stored(spark, lead.select("h", F.col("l.fp").alias("leader"), F.col("l.root").alias("l_root")), "op11-leaders")
        flow = m.join(lead, "h").where("root <> l_root")
    flow = stored(spark, flow.withColumn("salt", F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / RUN)).cast("int"))
                  .groupBy("leader", "l_root", "fp", "root").agg(F.min("salt").alias("salt")), "op11-flow")
    job = F.xxhash64("leader").alias("job")
    one = flow.select(job, F.lit(0).alias("blk"), "salt", F.lit(1).alias("side"), "fp", "root", F.lit(False).alias("rest"))
    held = flow.select("leader", "l_root", "salt").distinct().select(
        job, F.lit(0).alias("blk"), "salt", F.lit(0).alias("side"), F.col("leader").alias("fp"), F.col("l_root").alias("root"),
        F.lit(False).alias("rest"))
    return one.unionByName(held)


def _open_buckets(m: DataFrame) -> DataFrame:
    """(h, most, all, rest, nb): buckets of several components, their largest one, the members outside it and their blocks."""
    per = m.groupBy("h", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    big = per.groupBy("h").agg(F.max(F.struct("k", "root", "n")).alias("b"), F.sum("k").alias("all"), F.sum("n").alias("n")).where("all > b.k")
    rest = F.col("all") - F.col("b.k")
    blocks = F.ceil(F.greatest(rest / BLOCK, (F.col("n") - F.col("b.n")) / HELD)).cast("int")
    return big.select("h", F.col("b.root").alias("most"), "all", rest.alias("outside"), blocks.alias("nb"))


def _block_rows(m: DataFrame, big: DataFrame) -> DataFrame:
    """Members outside their bucket's largest component in blocks, against all members in runs."""
    x = (m.join(big, "h").withColumn("rest", F.col("root") != F.col("most"))
         .withColumn("ns", F.ceil(F.col("all") / RUN).cast("int")))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("nb")).cast("int")
    run = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("ns")).cast("int")
    # both sides of a member's rows in one pass over the join
    held = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda s: F.struct(
        own.alias("blk"), s.alias("salt"), F.lit(0).alias("side")))).otherwise(F.array())
    flow = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.struct(
        b.alias("blk"), run.alias("salt"), F.lit(1).alias("side")))
    return x.select(F.col("h").alias("job"), F.explode(F.concat(held, flow)).alias("j"), "fp", "root", "rest").select(
        "job", "j.blk", "j.salt", "j.side", "fp", "root", "rest")


_COLUMNS = ("job", "blk", "salt", "side", "fp", "root", "rest", "n", "sig")


def grouped(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, leaders: int = LEADERS) -> tuple[DataFrame, DataFrame]:
    """Signatures, and the classes with their component: (fp, rep_id, th, component_id, component_th)."""
    spark = docs.sparkSession
    bands, rows = choose_bands(percent, recall)
    sig = stored(spark, signatures(docs, bands, rows), "op11-signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th")).alias("r")
    classes = (sig.where("n > 0").groupBy("fp", "n").agg(least, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
               .select("fp", "n", F.col("r.doc_id").alias("rep_id"), F.col("r.th").alias("th"), "bands", "sig"))
    classes = stored(spark, classes, "op11-classes")
    members = stored(spark, bucket_members(classes), "op11-members")
    full = stored(spark, full_sets(docs, classes.drop("bands").join(members, "fp", "left_semi")), "op11-sets")
    links, roots, turn = [], None, 0
    while True:
        m, big = members.withColumn("root", F.col("fp")), None
        if roots is not None:
            m = stored(spark, members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "op11-rooted")
        last = turn >= leaders
        if turn or last:
            big = stored(spark, _open_buckets(m), "op11-open")
            outside = big.agg(F.max("outside")).first()[0]
            if outside is None:
                break
            last = last or outside <= REST
        if last:
            # most pairs are dropped here: screen on signatures first, then bring the sets of the others
            cand = stored(spark, _jobs(_block_rows(m, big).join(full.drop("set"), "fp").select(*_COLUMNS), percent, False), "op11-screened")
        else:
            cand = _leader_rows(m, turn)
        found = stored(spark, _jobs(cand.join(full, "fp").select(*_COLUMNS, "set"), percent, True), "op11-links")
        if not found.isEmpty():
            links.append(found)
            roots = components(reduce(DataFrame.unionByName, links))
        turn += 1
        if last:
            break
    c = classes.select("fp", "rep_id", "th")
    c = c.withColumn("root", F.col("fp")) if roots is None else c.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = c.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("nul"), "rep_id", "th")).alias("f"))
    return sig, stored(spark, c.join(first, "root").select(
        "fp", "rep_id", "th", F.col("f.rep_id").alias("component_id"), F.col("f.th").alias("component_th")), "op11-components")


def link(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, leaders: int = LEADERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id of its component), kept."""
    sig, c = grouped(docs, percent, recall, leaders)
    worded = sig.where("n > 0").select("doc_id", "n", "fp").join(c.select("fp", "component_id"), "fp").select("doc_id", "n", "component_id")
    out = worded.unionByName(sig.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, leaders: int = LEADERS) -> DataFrame:
    """Rows of ``docs``: one text of every component (that of its least id), and every text without words."""
    sig, c = grouped(docs, percent, recall, leaders)
    names = docs.columns
    taken = {n.lower() for n in names}
    th, one = ([p + "_" * k for k in range(99) if (p + "_" * k).lower() not in taken][0] for p in ("th", "one"))
    keep = c.select(F.col("component_id").alias("i"), F.col("component_th").alias("t")).distinct()
    bare = sig.where("n = 0").select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct()
    d = docs.withColumn(th, F.xxhash64("text"))
    same = d["doc_id"].eqNullSafe(F.col("i")) & (d[th] == F.col("t"))
    # rows that repeat id and text are one document of a component
    worded = d.join(keep, same, "left_semi").dropDuplicates(["doc_id", th])
    return worded.select(*names).unionByName(d.join(bare, same, "left_semi").select(*names))


def op11_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: every pair by its common shingles, then everything reachable; for small tables
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + {K - 1}), ' ') AS g
       FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - {K - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN c cx ON cx.rid = x JOIN c cy ON cy.rid = y WHERE 100 * k >= {PERCENT} * (cx.n + cy.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(rid, t) AS (SELECT rid, rid FROM d UNION SELECT r.rid, b.y FROM reach r JOIN both_ways b ON b.x = r.t),
comp AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.t GROUP BY r.rid)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, comp.component_id, d.doc_id IS NOT DISTINCT FROM comp.component_id AS kept
FROM d JOIN comp USING (rid) LEFT JOIN c USING (rid)
"""
