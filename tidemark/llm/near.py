"""Near copies by HyperMinHash: registers of leading zeros and mantissa bits, banded, estimated, confirmed on full sets.

1. Every text becomes the set of its word shingles. Sets that are equal form one class, named by its smallest id.
2. A set is dealt into `registers` buckets by a hash; a bucket's smallest value is kept as its leading zeros and the
   mantissa bits behind them. A bucket that stays empty takes the smallest of a hash of its own over the whole set, so
   that two sets agree in a register with a probability equal to their similarity at every size.
3. Classes that agree in all registers of a band meet in its bucket. Each class is first compared with the smallest
   members of its buckets, the three it meets most often, which joins a large group of copies with a few comparisons
   for each: an estimate, corrected for registers that agree by chance, keeps pairs within five standard errors of the
   limit, and the full sets decide. Components are the stars the links shrink to.
4. What then still lies in one bucket but in different components is compared set by set, in blocks of bounded size; a
   block returns one link for each two components it joins, so no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import Words, among, mix, per_worker, rows_out, text_blocks, written

ZERO_BITS, MANTISSA_BITS, VALUE_BITS = 6, 10, 44
SET_BITS = 52
BLOCK = 100_000  # shingles that are compared at once
SETS = 2_000  # sets of one side that are compared at once
SLICE = 512  # rows of a block's matrix that are looked at together


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) pairs without repetition, by text, then shingle; shingles are 52-bit hashes. At most 4096 texts."""
    doc, value = Words(data, offsets).shingles(width)
    both = np.unique(doc.astype(np.uint64) << np.uint64(SET_BITS) | value >> np.uint64(64 - SET_BITS))
    return (both >> np.uint64(SET_BITS)).astype(np.int64), both & np.uint64(2**SET_BITS - 1)


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 63) and the mantissa bits after the leading one of 44-bit values."""
    bits = np.frexp(values.astype(np.float64))[1]  # the bit length: values are below 2 ** 53
    zeros = np.minimum(VALUE_BITS - bits, 2**ZERO_BITS - 1)
    tail = np.where(bits > 0, (values << (VALUE_BITS + 1 - bits).astype(np.uint64)) & np.uint64(2**VALUE_BITS - 1), 0)
    return (zeros.astype(np.uint16) << MANTISSA_BITS) | (tail >> np.uint64(VALUE_BITS - MANTISSA_BITS)).astype(np.uint16)


def register_rows(doc: np.ndarray, value: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """One row of registers per text; rows of empty sets hold zeros. At most 2 ** 20 registers together."""
    mixed = mix(value, 1)
    bucket, low = mixed % np.uint64(registers), mix(mixed, 2) >> np.uint64(64 - VALUE_BITS)
    cell = (doc.astype(np.uint64) * np.uint64(registers) + bucket) << np.uint64(VALUE_BITS) | low
    out = np.full(n_texts * registers, 2**VALUE_BITS, np.uint64)
    cell.sort()
    place = (cell >> np.uint64(VALUE_BITS)).astype(np.int64)
    head = np.flatnonzero(np.diff(place, prepend=-1))
    out[place[head]] = cell[head] & np.uint64(2**VALUE_BITS - 1)
    out = out.reshape(n_texts, registers)
    starts = np.searchsorted(doc, np.arange(n_texts + 1))
    empty = out == 2**VALUE_BITS
    for t in np.flatnonzero(empty.any(axis=1) & (np.diff(starts) > 0)):
        members, holes = value[starts[t] : starts[t + 1]], np.flatnonzero(empty[t])
        with np.errstate(over="ignore"):
            own = mix(members[None, :] + (holes.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95), 3)
        out[t, holes] = own.min(axis=1) >> np.uint64(64 - VALUE_BITS)
    out[np.diff(starts) == 0] = 0
    return compress(out)


def chance_table() -> np.ndarray:
    """Probability that registers of two unrelated sets agree, by half log2 of the elements per bucket of each."""
    zeros, tail = np.arange(2**ZERO_BITS)[:, None], np.arange(2**MANTISSA_BITS)[None, :]
    low = 2.0 ** -(zeros + 1) * (1 + tail / 2**MANTISSA_BITS)
    high = 2.0 ** -(zeros + 1) * (1 + (tail + 1) / 2**MANTISSA_BITS)
    rates = 2.0 ** (np.arange(48) / 2)
    mass = np.stack([np.exp(rate * np.log1p(-low)) - np.exp(rate * np.log1p(-np.minimum(high, 1 - 1e-12))) for rate in rates])
    mass = mass.reshape(len(rates), -1)
    return mass @ mass.T


def estimate(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, registers: int) -> np.ndarray:
    """Similarity from the share of agreeing registers, less what agrees by chance."""
    table = per_worker("model", "chance", chance_table)

    def row(n: np.ndarray) -> np.ndarray:
        return np.clip(np.round(2 * np.log2(np.maximum(n / registers, 1))), 0, 47).astype(int)

    chance = table[row(n_a), row(n_b)]
    return (agree / registers - chance) / (1 - chance)


SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("registers", pa.binary())])


def signatures(docs: DataFrame, width: int, registers: int, id_col: str, text_col: str) -> DataFrame:
    """Set size, a 128-bit digest of the set and its registers, one row per document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(2 ** (64 - SET_BITS), 2**20 // registers)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                for lo, hi, data, offsets in text_blocks(part, "text", 500_000):
                    doc, value = shingle_sets(data, offsets, width)
                    n = hi - lo
                    sizes = np.bincount(doc, minlength=n)
                    cut = np.concatenate([[0], np.cumsum(sizes)])
                    digests = []
                    with np.errstate(over="ignore"):
                        for seed in (11, 12):
                            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value, seed))])
                            digests.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
                    rows = register_rows(doc, value, n, registers)
                    yield rows_out(SIGNATURE, [part.column("doc_id").slice(lo, n), sizes, *digests, [r.tobytes() for r in rows]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, registers binary")


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, rep): one row per class and band."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.stack([np.frombuffer(r, np.uint16) for r in batch.column("registers").to_pylist()]).astype(np.uint64)
                regs = regs.reshape(batch.num_rows, bands, rows)
                key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64), 5), (batch.num_rows, bands)).copy()
                for j in range(rows):
                    key = mix(key ^ regs[:, :, j], 6)
                reps = batch.column("rep").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(reps, bands))], names=["key", "rep"])

    return classes.select("rep", "registers").mapInArrow(keys, "key long, rep long")


def with_estimates(pairs: DataFrame, classes: DataFrame, registers: int, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least `least`, with the estimate."""
    side = {s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}")) for s in "ab"}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.stack([np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()]) for c in ("r_a", "r_b"))
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                est = estimate((ra == rb).sum(axis=1), na, nb, registers)
                keep = pa.array(est >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(est).filter(keep)], names=["a", "b", "estimate"])

    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(score, "a long, b long, estimate double")


def full_sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The shingle sets of the documents named."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2 ** (64 - SET_BITS)):
                part = batch.slice(at, 2 ** (64 - SET_BITS))
                for lo, hi, data, offsets in text_blocks(part, "text", 500_000):
                    doc, value = shingle_sets(data, offsets, width)
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(value.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("rep").slice(lo, hi - lo), lists], names=["rep", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    return among(rows, ids, "rep").mapInArrow(sets, "rep long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B|. A member of very many pairs can be split by the join, as
    nothing behind it needs a key's rows together."""
    side = {s: sets.select(F.col("rep").alias(s), F.col("shingles").alias(f"s_{s}")) for s in "ab"}
    both = F.size(F.array_intersect("s_a", "s_b"))
    either = F.size("s_a") + F.size("s_b") - both
    return pairs.select("a", "b").join(side["a"], "a").join(side["b"], "b").where(100 * both >= percent * either).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(rep, root) for every node of an undirected graph that is no root itself; root is the smallest node reachable.

    Large and small stars alternate until nothing changes: every node points to the smallest node it knows, and so do
    its larger, then its smaller neighbours. Each round is written to the shared folder.
    """

    def state(stars: DataFrame) -> tuple:
        return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    before = state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "stars")
        after = state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("rep"), F.col("v").alias("root"))


def block_links(rep: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components of a block, one for each two components they join.

    Intersections of all sets are the product of the matrix (set, shingle) with itself, by slices of its columns; a
    shingle of one set alone adds nothing.
    """
    n = np.array([s.size for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n.size), n), count[column] > 1
    place = (np.cumsum(count > 1) - 1)[column[shared]]
    row, order = row[shared], np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((n.size, n.size), np.float32)
    cuts = np.searchsorted(place, np.arange(0, int(place[-1]) + 1 + 8192, 8192)) if place.size else []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = np.zeros((n.size, 8192), np.float32)
        part[row[lo:hi], place[lo:hi] - 8192 * k] = 1
        both += part @ part.T
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for lo in range(0, n.size, SLICE):
        mine = slice(lo, lo + SLICE)
        either = n[mine, None] + n[None, :] - both[mine]
        x, y = np.nonzero((100 * both[mine] >= percent * either) & (comp[mine, None] != comp[None, :]) & (rep[mine, None] < rep[None, :]))
        for i, j in zip((x + lo).tolist(), y.tolist(), strict=True):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[a] = b
                out.append((int(rep[i]), int(rep[j])))
    return out


def block_members(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, rep, comp): the blocks `g` in which the members of open buckets are compared.

    A bucket of more than BLOCK shingles or SETS sets is compared in blocks of about so many of each side; then the
    members of its largest component are in one part each, and only the others go to several.
    """
    sized = members.join(labels, "rep", "left").join(classes.select("rep", "n_shingles"), "rep")
    known = sized.select("key", "rep", "n_shingles", F.coalesce("root", "rep").alias("comp"))
    by_comp = known.groupBy("key", "comp").agg(F.sum("n_shingles").alias("n"), F.count("*").alias("sets"))
    open_keys = (by_comp.groupBy("key").agg(F.max(F.struct("n", "comp", "sets")).alias("main"), F.sum("n").alias("k"), F.sum("sets").alias("sets"), F.count("*").alias("comps"))
                 .where("comps > 1").select("key", F.col("main.comp").alias("main"), F.col("main.n").alias("c"), F.col("main.sets").alias("sets_c"), "k", "sets"))
    rows = known.join(open_keys, "key").withColumn("is_main", F.col("comp") == F.col("main"))

    def parts(shingles, sets):
        return F.greatest(F.ceil(shingles / BLOCK), F.ceil(sets / SETS))

    blocks_c, blocks_r = parts(F.col("c"), F.col("sets_c")), parts(F.col("k") - F.col("c"), F.col("sets") - F.col("sets_c"))

    def upto(n):
        return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)

    def cell(kind, i, j):
        return F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))

    mine_c, mine_r = F.pmod(F.xxhash64("rep"), blocks_c), F.pmod(F.xxhash64("rep"), blocks_r)
    whole = F.array(cell("a", F.lit(0), F.lit(0)))
    of_main = F.transform(upto(blocks_r), lambda j: cell("m", mine_c, j))
    of_rest = F.concat(F.transform(upto(blocks_c), lambda i: cell("m", i, mine_r)),
                       F.transform(upto(blocks_r), lambda j: cell("r", F.least(mine_r, j), F.greatest(mine_r, j))))
    cells = F.when((F.col("k") <= BLOCK) & (F.col("sets") <= SETS), whole).when(F.col("is_main"), of_main).otherwise(of_rest)
    return rows.select("key", "rep", "comp", F.explode(cells).alias("cell")).select(F.xxhash64("key", "cell").alias("g"), "rep", "comp")


def rest_links(members: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket in different components, from all such pairs of every bucket."""
    dealt = block_members(members, classes, labels).join(sets, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done() -> list[tuple[int, int]]:
            rep, comp = (np.concatenate([p[k] for p in parts]) for k in range(2))
            return block_links(rep, comp, [s for p in parts for s in p[2]], percent)

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, rep, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "rep", "comp"))
            lists = batch.column("shingles")
            values, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            heads = np.concatenate([np.flatnonzero(np.diff(g, prepend=g[0] - 1)), [g.size]])
            for lo, hi in zip(heads, heads[1:], strict=False):
                if parts and g[lo] != now:
                    yield out(done())
                    parts = []
                now = g[lo]
                parts.append((rep[lo:hi], comp[lo:hi], [values[at[i] : at[i + 1]] for i in range(lo, hi)]))
        if parts:
            yield out(done())

    return dealt.repartition("g").sortWithinPartitions("g").select("g", "rep", "comp", "shingles").mapInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id linked to it, itself included), kept.

    Documents are linked if their sets of `width`-word shingles have a similarity of `percent` at least. A text without
    words, or null, has an empty set and is linked with nothing. Rows of one id are one document of several texts. A row
    without an id keeps its row and is linked with nothing (component_id null, kept true). An empty table gives no rows.
    """
    registers = bands * rows
    limit = percent / 100
    least = limit - 5 * (limit * (1 - limit) / registers) ** 0.5
    rows_all = written(signatures(docs, width, registers, id_col, text_col), "signatures")
    named = rows_all.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["n_shingles", "f1", "f2"]
    classes = written(named.groupBy(*digest).agg(F.min(F.struct("doc_id", "registers")).alias("first"))
                      .select(*digest, F.col("first.doc_id").alias("rep"), F.col("first.registers").alias("registers")), "classes")
    keyed = band_keys(classes, bands, rows)
    shared = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("key", "hub")
    members = written(keyed.join(written(shared, "hubs"), "key"), "members")

    votes = members.where("rep <> hub").groupBy("rep", "hub").count()
    order = Window.partitionBy("rep").orderBy(F.desc("count"), "hub")
    spokes = votes.withColumn("r", F.row_number().over(order)).where("r <= 3").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    first = written(with_estimates(spokes, classes, registers, least).select("a", "b"), "spokes")
    ids = members.select("rep").distinct()
    sets = written(full_sets(docs, written(ids, "ids"), width, id_col, text_col), "sets")
    edges = written(confirmed(first, sets, percent), "links")
    labels = components(edges)
    more = rest_links(members, classes, sets, labels, percent)
    labels = components(edges.unionByName(written(more, "rest")))

    roots = classes.join(labels, "rep", "left").select(*digest, "rep", F.coalesce("root", "rep").alias("root"))
    whole = rows_all.select("doc_id", *digest)
    linked = whole.join(roots.select(*digest, "root"), digest, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("root"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
