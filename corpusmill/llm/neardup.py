"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations give the whole signature: the first (the shingle hash, folded to a universe of 2**20 places) shuffles
the shingles; the second, a fixed table of those places, is circularly shifted by 0..K-1 for coordinates 0..K-1, so that
coordinate k of a document is the least table entry at (place + k). 32 bands of 4 coordinates make a pair at similarity
0.8 collide in no band with probability 5e-8.

Skew. Documents with equal shingle sets collapse into one class first. In each bucket every class is compared with the
bucket's least class (a star, not all pairs). After the components of those verified links are known, only classes of one
bucket that still lie in different components are compared: pair by pair in buckets of at most SMALL classes, so that a class
has a bounded number of pairs a bucket; in larger buckets, put together by the component that has most of their classes, in
blocks of about BLOCK classes by BLOCK (fewer of long texts: about BLOCK_SHINGLES shingles a side), which count common shingles by matrix products and return links only, a spanning forest of
them at most. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_id, mix64, slices

BANDS, ROWS, UNIVERSE_BITS, SEED = 32, 4, 20, 1
SMALL, BLOCK, BLOCK_SHINGLES = 32, 128, 1 << 20


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's `width`-word shingles, A-Z lower-cased, words split at ASCII white
    space. Fewer words than `width`: the whole sequence is one shingle; no word: empty."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _signer(bands: int, rows: int):
    k, size = bands * rows, 1 << UNIVERSE_BITS
    order = np.random.RandomState(SEED).permutation(size).astype(np.int32)
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: k - 1]]), k)

    def sign(hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
        return reduce(np.minimum, (shifted[at[i : i + 2048]].min(axis=0) for i in range(0, len(at), 2048)))

    return sign


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    out = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(signatures), 1), np.uint64)
    for part in signatures.astype(np.uint64).reshape(len(signatures), bands, rows).transpose(2, 0, 1):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + part)
    return out.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, h1, h2, keys): size, two hashes and band keys of each document's shingle set; no keys if empty."""

    def run(batches):
        sign = _signer(bands, rows)
        for batch in (b for whole in batches for b in slices(whole, 1024)):
            n, h1, h2, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                h1.append(np.add.reduce(mix64(s)) if len(s) else np.uint64(0))
                h2.append(np.bitwise_xor.reduce(mix64(s + np.uint64(n[-1]))) if len(s) else np.uint64(0))
                if len(s):
                    sigs.append(sign(s))
            keys = _band_keys(np.array(sigs).reshape(len(sigs), bands * rows), bands, rows) if sigs else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.array(n) > 0) * bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                ["id", "n_shingles", "h1", "h2", "keys"],
            )

    return docs.mapInArrow(run, f"id {_kind(docs)}, n_shingles long, h1 long, h2 long, keys array<long>")


def _shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the sorted hashes of those documents, as little-endian unsigned 64-bit integers."""

    def sets(batches):
        for batch in (b for whole in batches for b in slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    return docs.join(ids, "id", "left_semi").mapInArrow(sets, f"id {_kind(docs)}, shingles binary")


def _kind(df: DataFrame, name: str = "id") -> str:
    """The SQL type of an id column, long or string."""
    return "string" if df.schema[name].dataType.simpleString() == "string" else "long"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (x, y) whose full shingle sets have 100 * intersection >= percent * union."""

    def confirm(batches):
        for batch in (b for whole in batches for b in slices(whole)):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")
    return both.mapInArrow(confirm, f"x {_kind(pairs, 'x')}, y {_kind(pairs, 'x')}")


def _block_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of different labels. Only a row of `left` with one of `right` counts, if the two differ."""
    left, right = [r for r in rows if r["left"]], [r for r in rows if r["right"]]
    if not left or not right:
        return []
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in left + right]
    size = np.array([len(s) for s in sets])
    tokens, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    place = np.cumsum(often > 1) - 1
    shared = often[at] > 1
    owner, place = owner[shared], place[at][shared]
    common = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int((often > 1).sum()), 8192):
        part = (place >= lo) & (place < lo + 8192)
        has = np.zeros((len(sets), 8192), np.float32)
        has[owner[part], place[part] - lo] = 1
        common += has[: len(left)] @ has[len(left) :].T
    a, b = size[: len(left), None], size[None, len(left) :]
    hit = 100 * common.astype(np.int64) >= percent * (a + b - common.astype(np.int64))
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    links = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = left[i], right[j]
        if x["label"] != y["label"] and (p := root(x["label"])) != (q := root(y["label"])):
            up[p] = q
            links.append((x["rep"], y["rep"]))
    return links


def _across_blocks(named: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (x, y) between classes of different components that share a large bucket. named: (key, rep, n, label), mixed large buckets only."""
    kind = _kind(named, "rep")
    id_type = pa.string() if kind == "string" else pa.int64()

    def link(table):
        found = _block_links(table.to_pylist(), percent)
        return pa.table([pa.array([p[k] for p in found], id_type) for k in (0, 1)], ["x", "y"])

    counts = named.groupBy("key", "label").count()
    # Tables, not aggregates, on both sides of a join: Spark then splits a key that has most rows.
    most = scratch.keep(counts.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("dom")))
    rows = named.join(most, "key").groupBy("dom", "rep").agg(F.any_value("label").alias("label"), F.any_value("n").alias("n"))
    rows = scratch.keep(rows.withColumn("own", F.col("dom") == F.col("label")))
    parts = lambda x: F.ceil(F.greatest(F.count_if(x) / BLOCK, F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = rows.groupBy("dom").agg(*[parts(x).alias(name) for name, x in (("na", F.col("own")), ("no", ~F.col("own")))])
    rows = rows.join(scratch.keep(blocks), "dom").where("no > 0").withColumn("i", F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("na")).otherwise(F.col("no"))).cast("int"))
    spot = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("bi"), j.alias("bj"), left.alias("left"), right.alias("right"))
    yes, no, i = F.lit(True), F.lit(False), F.col("i")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    of_own = F.transform(upto("no"), lambda j: spot(0, j, i, no, yes))
    of_other = F.concat(F.transform(upto("na"), lambda j: spot(0, i, j, yes, no)), F.transform(upto("no"), lambda j: spot(1, F.least(i, j), F.greatest(i, j), i <= j, j <= i)))
    spread = rows.select("dom", "rep", "label", F.explode(F.when(F.col("own"), of_own).otherwise(of_other)).alias("at")).select("dom", "rep", "label", "at.*")
    full = spread.join(sets.withColumnRenamed("id", "rep"), "rep")
    return full.groupBy("dom", "kind", "bi", "bj").applyInArrow(link, f"x {kind}, y {kind}")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each node of edges (x, y): label is the least node reachable.

    Each round takes the least label of the neighbours, then the label of that label; the rounds needed grow with
    the logarithm of the longest path for the shapes that stars give. Each round's labels are a written table."""
    both = scratch.keep(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = scratch.keep(both.groupBy(F.col("x").alias("node")).agg(F.least("node", F.min("y")).alias("label")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        stepped = scratch.keep(labels.join(near, labels.node == near.x).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        parents = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = scratch.keep(stepped.join(parents, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("moved")))
        changed = jumped.where("moved").limit(1).count()
        scratch.drop(labels, stepped)
        labels = jumped.select("node", "label")
        labels._corpusmill_path = jumped._corpusmill_path
        if not changed:
            scratch.drop(both)
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id, kept).

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the least id
    reachable, kept says whether it is the row's own. Null, empty and blank texts have no shingles and link with nothing.
    Rows that share an id stand for one document with all their texts. A null id has a null component and is kept.
    Ids are integers or strings. A very long text is one set of shingles, compared whole. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = scratch.keep(signatures(docs, width))
    real = signed.where("n_shingles > 0 and id is not null")
    classes = scratch.keep(real.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("keys").alias("keys")))
    bands = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = scratch.keep(bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.min_by("n", "rep").alias("lead_n")).where("lead < last").select("key", "lead", "lead_n"))
    members = scratch.keep(bands.join(shared, "key").select("key", "rep", "n", "lead", "lead_n"))
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    stars = scratch.keep(members.where((F.col("rep") != F.col("lead")) & fits(F.col("n"), F.col("lead_n"))).select(F.col("rep").alias("x"), F.col("lead").alias("y")).distinct())
    sets = scratch.keep(_shingle_sets(docs, members.select(F.col("rep").alias("id")).distinct(), width))
    links = scratch.keep(_verified(stars, sets, percent))
    labels = components(links, scratch)

    named = scratch.keep(members.join(labels, members.rep == labels.node, "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label")))
    mixed = scratch.keep(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("classes")).where("lo < hi").select("key", "classes"))
    left = scratch.keep(named.join(mixed, "key"))
    a, b = (left.where(F.col("classes") <= SMALL).alias(k) for k in "ab")
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label")) & fits(F.col("a.n"), F.col("b.n"))).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct()
    more = scratch.keep(_verified(across, sets, percent).union(_across_blocks(left.where(F.col("classes") > SMALL), sets, percent, scratch)))
    if more.limit(1).count():
        labels = components(links.union(more), scratch)
    scratch.drop(members, named, mixed, left, shared, sets, stars)

    found = classes.join(labels, classes.rep == labels.node, "left").select("h1", "h2", F.col("n_shingles").alias("n"), "copies", "rep", F.coalesce("label", "rep").alias("label"))
    # Only classes of several rows, or linked with a lower one, differ from "its own component".
    told = scratch.keep(found.where("copies > 1 or label < rep").select("h1", "h2", "n", "label"))
    scratch.drop(classes, links, more, labels)
    rows = signed.select("id", "n_shingles", "h1", "h2")
    same = (rows.h1 == told.h1) & (rows.h2 == told.h2) & (rows.n_shingles == told.n) & rows.id.isNotNull()
    out = rows.join(told, same, "left").select("id", "n_shingles", F.coalesce("label", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle_sql() -> str:
    """DuckDB SQL of op9's rows. Sets at 80 % share one of their rarest shingles (as many of each as may be missing, and one); closure of the links gives components."""
    return r"""
    with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as w from documents),
    s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from w where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    r as (select doc_id, s, n, row_number() over (partition by doc_id order by c, s) as r from s join n using (doc_id) join (select s, count(*) as c from s group by s) using (s)),
    p as (select doc_id, s, n from r where r <= n - (80 * n + 99) // 100 + 1),
    c as (select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from p a join p b on a.s = b.s and a.doc_id < b.doc_id where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    l as (select x, y from c join s a on a.doc_id = x join s b on b.doc_id = y and a.s = b.s group by x, y, nx, ny having 100 * count(*) >= 80 * (nx + ny - count(*))),
    e as (select x, y from l union all select y, x from l),
    g as (select x, y from e union select g.x, e.y from g join e on g.y = e.x),
    m as (select x, min(y) as y from g group by x)
    select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id, doc_id <= coalesce(y, doc_id) as kept from w left join n using (doc_id) left join m on x = doc_id
    """
