"""Near-duplicate documents by probability Jaccard: ProbMinHash signatures, bands, verification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lindero.llm.common import (
    ROW, join_texts, mix64, pack, small_batches, unpack, word_hashes,
)
from lindero.llm.graph import Forest, components
from lindero.session import settle

SHINGLE = 5           # words
THRESHOLD = 0.8       # of probability Jaccard, from which two documents are linked
BANDS, ROWS = 32, 4   # a pair at the threshold is missed with chance (1 - 0.8 ** 4) ** 32 < 1e-7
REGISTERS = BANDS * ROWS
# Pairs whose estimate is below are not verified: 5 standard deviations under the threshold.
ESTIMATE = 0.62
TILE = 256            # rows of a bucket that are compared with as many others in one step
COLUMNS = 1 << 14     # shingles of a block of their products
_STEP, _PLACE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_ALL = (1 << 64) - 1


def normal(text: str = "text") -> Column:
    """Small letters, words parted by single spaces: what two copies must share."""
    spaced = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    return F.btrim(spaced, F.lit(" "))


def text_key(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle, count), sorted by text and shingle, each once.

    A shingle is five words in a row; a text of one to four words has one shingle of all of them,
    a text without words none.
    """
    data, starts = join_texts(texts)
    where, words = word_hashes(data)
    of = np.searchsorted(starts, where, "right") - 1
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    k = np.uint64(0x2545F4914F6CDD1D)
    rolled = words[:max(0, len(words) - SHINGLE + 1)].copy()
    for j in range(1, SHINGLE):
        rolled = rolled * k + words[j:j + len(rolled)]
    whole = of[:len(rolled)] == of[SHINGLE - 1:SHINGLE - 1 + len(rolled)]
    owner, value = of[:len(rolled)][whole], mix64(rolled[whole])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for x, i in enumerate(short):
            for w in words[first[i]:first[i] + n[i]].tolist():
                extra[x] = np.uint64((int(extra[x]) * int(k) + w) & 0xFFFFFFFFFFFFFFFF)
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, mix64(extra + np.uint64(1))])
    packed = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    if not len(packed):
        return np.zeros(0, np.int64), packed, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    count = np.diff(np.append(at, len(packed)))
    packed = packed[at]
    return ((packed >> np.uint64(48)).astype(np.int64),
            packed & np.uint64((1 << 48) - 1), count)


def signatures(texts: list[str]) -> list[bytes | None]:
    """ProbMinHash signature of each text, 16 bits a register; None for a text without words.

    Every shingle sends a Poisson stream of points whose rate is its count in the text; a point
    falls on a register and the earliest shingle of each register is the signature. The streams
    depend on the shingle alone, so two texts agree in a register with their probability Jaccard.
    A text's streams stop as soon as all registers are taken earlier than any point to come.
    """
    owner, shingle, count = shingles(texts)
    n = len(texts)
    total = np.bincount(owner, weights=count, minlength=n)
    # Beyond this time a register is still free with a small chance; then the text goes on.
    limit = REGISTERS * (np.log(REGISTERS) + 5.0) / np.maximum(total, 1)
    earliest = np.full(n * REGISTERS, np.inf)
    found = np.zeros(n * REGISTERS, dtype=np.uint64)
    active = np.arange(len(owner))
    time = np.zeros(len(owner))
    step = 0
    while len(active):
        step += 1
        s = shingle[active]
        u = mix64(s * np.uint64(_PLACE) + np.uint64(step * _STEP & _ALL))
        chance = ((u >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        at = time[active] - np.log(chance) / count[active]
        time[active] = at
        here = at <= limit[owner[active]]
        active, at, s = active[here], at[here], s[here]
        place = owner[active] * REGISTERS + (
            mix64(s * np.uint64(_STEP) + np.uint64(step * _PLACE & _ALL)) % np.uint64(REGISTERS)
        ).astype(np.int64)
        np.minimum.at(earliest, place, at)
        won = earliest[place] == at
        found[place[won]] = s[won]
        last = earliest.reshape(n, REGISTERS).max(axis=1)
        full = np.isfinite(last)
        limit = np.where(full, np.minimum(limit, last), limit)
        if not len(active):  # texts with a free register: twice the time, from the start
            late = ~full & (total > 0)
            if late.any():
                limit = np.where(late, limit * 2, 0.0)
                active = np.flatnonzero(late[owner])
                time[active] = 0.0
                step = 0
                earliest.reshape(n, REGISTERS)[late] = np.inf
    folded = (mix64(found) >> np.uint64(48)).astype("<u2").reshape(n, REGISTERS)
    return [folded[i].tobytes() if total[i] else None for i in range(n)]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted shingle sets (shingle, count), shingles in order.

    The sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i): with the shared shingles
    in order of a_j / b_j the inner sums are running totals.
    """
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    va, vb = a[1].astype(np.float64), b[1].astype(np.float64)
    only_a, only_b = va.sum() - va[x].sum(), vb.sum() - vb[y].sum()
    sa, sb = va[x], vb[y]
    ratio = sa / sb
    order = np.argsort(ratio, kind="stable")
    sa, sb, ratio = sa[order], sb[order], ratio[order]
    # for shared i: sum of max(a_j, ratio_i * b_j) = a over larger ratios, b over smaller ones
    b_upto = np.cumsum(sb)
    a_after = sa.sum() - np.cumsum(sa)
    inner = only_a + a_after + ratio * (only_b + b_upto)
    return float((sa / inner).sum())


def sign(docs: DataFrame) -> DataFrame:
    """(key, doc_id, sig) of every document: key is the digest of its normalised text."""
    small_batches(docs.sparkSession)
    own = docs.select(normal().alias("norm"), "doc_id").withColumn("key", text_key(F.col("norm")))
    schema = T.StructType([T.StructField("key", T.BinaryType()), own.schema["doc_id"],
                           T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "doc_id": batch.column("doc_id"),
                "sig": pa.array(signatures(batch.column("norm").to_pylist()), pa.binary())})

    return own.select("key", "doc_id", "norm").mapInArrow(run, schema)


def _estimated(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough registers."""
    side = sigs.select("key", "sig")
    both = (pairs.join(side.toDF("a", "sig_a"), "a").join(side.toDF("b", "sig_b"), "b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2")
                    .reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            keep = pa.array((x == y).mean(axis=1) >= ESTIMATE)
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c).filter(keep) for c in ("a", "b")})

    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose exact probability Jaccard reaches the threshold."""
    both = pairs.join(texts.toDF("a", "norm_a"), "a").join(texts.toDF("b", "norm_b"), "b")

    def run(batches):
        @lru_cache(maxsize=64)
        def of(text):
            _, shingle, count = shingles([text])
            return shingle, count

        for batch in batches:
            a, b = batch.column("norm_a").to_pylist(), batch.column("norm_b").to_pylist()
            keep = pa.array([probability_jaccard(of(x), of(y)) >= THRESHOLD - 1e-9
                             for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c).filter(keep) for c in ("a", "b")})

    return both.mapInArrow(run, "a binary, b binary")


def _tiled(rest: DataFrame) -> DataFrame:
    """Each bucket's rows dealt to tiles of about TILE rows; a row for each tile it is held against."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    return (rest.withColumn("tile", F.pmod(F.xxhash64("key"), tiles).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
            .select("band", "value", F.least("tile", "other").alias("i"),
                    F.greatest("tile", "other").alias("j"), "tile", "key", "label", "sig"))


TILE_KEYS = ["band", "value", "i", "j"]


def _by_tile(df: DataFrame) -> DataFrame:
    """The rows of a pair of tiles, 2 * TILE at most in expectation, next to each other."""
    return df.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)


def _runs(batches):
    """The rows of each pair of tiles as one table, whatever batches they come in."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        names = list(zip(*(table.column(k).to_pylist() for k in TILE_KEYS)))
        edges = [0] + [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)]
        for start, end in zip(edges, edges[1:]):
            part = table.slice(start, end - start)
            if held and held[-1].select(TILE_KEYS).slice(0, 1) != part.select(TILE_KEYS).slice(0, 1):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _candidates(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles that this bucket is the first to share, in different components,
    and whose signatures agree well enough."""
    tile = np.asarray(group.column("tile"))
    i, j, band = (group.column(k)[0].as_py() for k in ("i", "j", "band"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, REGISTERS)
    bands = np.ascontiguousarray(sig).view("<u8").reshape(-1, BANDS)[:, :band]
    label = np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    a, b = [], []
    for at in range(0, len(left), 64):
        x = left[at:at + 64]
        fit = label[x][:, None] != label[right][None]
        if i == j:
            fit &= x[:, None] < right[None]
        p, q = np.nonzero(fit)
        p, q = x[p], right[q]
        first = ~(bands[p] == bands[q]).any(axis=1)
        p, q = p[first], q[first]
        near = (sig[p] == sig[q]).mean(axis=1) >= ESTIMATE
        a.append(p[near])
        b.append(q[near])
    return np.concatenate(a), np.concatenate(b)


def _near_tiles(batches):
    """The rows of each pair of tiles that have a partner to be verified there."""
    for group in _runs(batches):
        p, q = _candidates(group)
        if len(p):
            yield from group.take(pa.array(np.unique(np.concatenate([p, q])))).combine_chunks(
                ).to_batches()


def _joined_tiles(batches):
    """Links that join up the verified pairs of two tiles: at most one for each row."""
    for group in _runs(batches):
        p, q = _candidates(group)
        owner, shingle, count = shingles(group.column("norm").to_pylist())
        linked = exact_links(len(group), owner, shingle, count, p, q)
        joined = Forest(group.num_rows)
        joined.join(p[linked], q[linked])
        some = np.flatnonzero(joined.label != np.arange(group.num_rows))
        keys = group.column("key").combine_chunks()
        yield pa.RecordBatch.from_pydict({
            "a": keys.take(pa.array(some)), "b": keys.take(pa.array(joined.label[some]))})


def exact_links(n: int, owner: np.ndarray, shingle: np.ndarray, count: np.ndarray,
                p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs (p, q) of n texts reach the threshold.

    The weight a text shares with another bounds the similarity from above, and for texts without
    repeated shingles gives it: both come from products of the shingle counts, column block by
    block. What the bound leaves of the other pairs is worked out one by one.
    """
    first = np.searchsorted(owner, np.arange(n + 1))
    total = np.bincount(owner, weights=count, minlength=n)
    plain = np.bincount(owner, weights=count, minlength=n) == np.diff(first)
    values, column, uses = np.unique(shingle, return_inverse=True, return_counts=True)
    rank = np.cumsum(uses > 1) - 1                     # only shingles of two texts matter
    shared = uses[column] > 1
    rows, columns, counts = owner[shared], rank[column[shared]], count[shared]
    weight = np.zeros((n, n), dtype=np.float64)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        here = (columns >= low) & (columns < low + COLUMNS)
        block = np.zeros((n, COLUMNS), dtype=np.float32)
        block[rows[here], columns[here] - low] = counts[here]
        weight += block @ (block > 0).astype(np.float32).T
    a, b = weight[p, q], weight[q, p]
    both = plain[p] & plain[q]
    exact = a / np.maximum(1, total[p] + total[q] - a)
    bound = np.minimum(a / np.maximum(1, total[p]), b / np.maximum(1, total[q]))
    linked = both & (exact >= THRESHOLD - 1e-9)
    for k in np.flatnonzero(~both & (bound >= THRESHOLD - 1e-9)):
        x, y = slice(first[p[k]], first[p[k] + 1]), slice(first[q[k]], first[q[k] + 1])
        linked[k] = probability_jaccard((shingle[x], count[x]), (shingle[y], count[y])
                                        ) >= THRESHOLD - 1e-9
    return linked


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, label) of every linked text, and (key, doc_id) of every document with words.

    Banding: texts that agree in the registers of a band share a bucket. First each bucket's
    texts are compared with one leader, the text that shares most buckets with others; a large
    group of near copies is joined up so with work in proportion to its size. Then every pair of
    a bucket that is still in different components is compared, tile by tile within tasks that
    return only the links that join components: no table of pairs is made, a pair that shares
    several buckets is looked at in the first, and what is skipped is pairs already connected.
    """
    signed = settle(sign(docs), "signed")
    signed = signed.filter(F.col("sig").isNotNull())
    sigs = settle(signed.groupBy("key").agg(F.max("sig").alias("sig")), "signatures")
    banded = sigs.select("key", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias(
            "band", "value"))
    crowded = (banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > 1))
    members = settle(banded.join(crowded, ["band", "value"]), "members")
    renown = members.groupBy("key").agg(F.sum("n").alias("renown"))
    ranked = members.join(renown, "key")
    leaders = ranked.groupBy("band", "value").agg(
        F.max(F.struct("renown", "key")).alias("top"))
    first = (members.join(leaders.select("band", "value", F.col("top.key").alias("leader")),
                          ["band", "value"])
             .filter(F.col("key") != F.col("leader"))
             .select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
             .distinct())
    needed = members.select("key").distinct()
    own = docs.select(normal().alias("norm")).withColumn("key", text_key(F.col("norm")))
    texts = settle(own.join(needed, "key", "left_semi").groupBy("key")
                   .agg(F.any_value("norm").alias("norm")), "texts")
    found = settle(_verified(_estimated(first, sigs), texts), "found")
    labels = components(found)
    placed = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "value", "n", "key", F.coalesce("label", "key").alias("label"))
    # A bucket of two has been settled by its leader, one with a single label needs nothing more.
    placed = settle(placed.filter(F.col("n") > 2), "placed")
    mixed = (placed.groupBy("band", "value")
             .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter(F.col("lo") != F.col("hi")).select("band", "value"))
    rest = _tiled(placed.join(mixed, ["band", "value"], "left_semi").join(sigs, "key"))
    needed = settle(_by_tile(rest).mapInArrow(_near_tiles, rest.schema), "needed")
    more = settle(_by_tile(needed.join(texts, "key")).mapInArrow(
        _joined_tiles, "a binary, b binary"), "found")
    if more.isEmpty():
        return labels, signed.select("key", "doc_id")
    merged = found.union(more)
    return components(merged), signed.select("key", "doc_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, component_id, kept.

    class_id is the smallest doc_id with an equal normalised text (small letters, white space
    folded), component_id the smallest doc_id reachable over links of probability Jaccard 0.8 or
    more on five-word shingles weighted by their counts; kept is doc_id = component_id.

    Documents without words (null and empty texts) are linked with nothing. Rows with equal
    doc_id and text give equal rows. Null doc_ids take part in the links but are never the
    smallest unless all are null. An empty table gives an empty table. Other columns are ignored.
    """
    labels, signed = links(docs)
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    labelled = settle(classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "class_id", F.coalesce("label", "key").alias("label")), "labelled")
    heads = labelled.groupBy("label").agg(F.min("class_id").alias("component_id"))
    known = labelled.join(heads, "label").select("key", "class_id", "component_id")
    empty = docs.select("doc_id", normal().alias("norm")).filter(F.col("norm") == "").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    rows = signed.join(known, "key").select("doc_id", "class_id", "component_id").union(empty)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                              F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near duplicates, same columns.

    Kept is the row of the smallest doc_id, null last; among rows that share it, equal rows too, one.
    Null and empty texts, and others without words, are near nothing: all such rows stay. Texts of any
    length are compared whole. Columns of any name are kept. An empty table gives an empty table.
    """
    labels, signed = links(docs)
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    labelled = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "class_id", F.coalesce("label", "key").alias("label"))
    chosen = labelled.groupBy("label").agg(
        F.min(F.struct(F.col("class_id").isNull(), "class_id", "key")).alias("best"))
    keys = settle(chosen.select(F.col("best.key").alias("key"), F.col("best.class_id").alias(
        "class_id")), "chosen")
    own = docs.select(pack(docs), "doc_id", normal().alias("norm"))
    empty = own.filter(F.col("norm") == "").select(*unpack(docs.columns))
    kept = (own.filter(F.col("norm") != "").withColumn("key", text_key(F.col("norm"))).drop("norm")
            .join(keys, "key", "left_semi")
            .groupBy("key").agg(F.min_by(ROW, F.struct(
                F.col("doc_id").isNull(), "doc_id", F.xxhash64(ROW))).alias(ROW)))
    return kept.select(*unpack(docs.columns)).union(empty)
