"""Near duplicates: MinHash bands, signature and exact verification, components.

Documents with equal shingle sets form a class first, so copies never meet
each other again. Bands of universal-hash minima put classes into buckets.
Within a bucket the members are compared with one leader, the most central one. Members that this
leaves in different components meet only if they share a difference from the
leader that any link between them would have to share; so a group of n near
copies costs about n comparisons, and no link between members of a bucket is
lost. Pairs with the leader pass an estimate from their signatures; all links
are confirmed on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import text as tx
from scriptorium.llm.graph import components
from scriptorium.llm.store import forget, stored

SHINGLE, PERCENT = 5, 75
#: At a similarity of 0.75 all 40 bands of 4 minima miss with probability 2.5e-7.
BANDS, ROWS = 40, 4
#: Pairs whose signatures agree on less than this share are not confirmed: six standard deviations below 0.75.
AGREE = 0.54

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("signature", pa.binary())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_sets(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of lower-cased words, document after document, and how many each document has.

    A document of fewer than SHINGLE words has its whole sequence as the only shingle, one without words has none.
    """
    words = chunk.lowered().words
    grams, at = words.grams(SHINGLE)
    doc = words.doc[at]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            grams = np.concatenate([grams, tx.gram_hashes(words.hashes, words.first[short], n)])
            doc = np.concatenate([doc, short])
    # within a document equal keys are equal shingles
    keys = grams ^ tx.mix(np.arange(1, len(chunk) + 1, dtype=np.uint64))[doc]
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keep = np.sort(order[new])
    keep = keep[np.argsort(doc[keep], kind="stable")] if np.any(np.diff(doc[keep]) < 0) else keep
    return grams[keep], np.bincount(doc[keep], minlength=len(chunk))


def _sketch(chunk: tx.Chunk) -> dict:
    sets, sizes = shingle_sets(chunk)
    full = np.flatnonzero(sizes)
    at = (np.cumsum(sizes) - sizes)[full]
    digests = [np.zeros(len(chunk), np.uint64) for _ in range(2)]
    minima = np.zeros((len(chunk), BANDS * ROWS), "<u2")
    if len(full):
        for out, salt in zip(digests, (0, 0xA5A5A5A5), strict=True):
            out[full] = np.add.reduceat(tx.mix(sets ^ np.uint64(salt)), at)
        for k in range(BANDS * ROWS):
            minima[full, k] = (tx.mix(np.minimum.reduceat(sets * _A[k] + _B[k], at)) >> np.uint64(48)).astype("<u2")
    return {
        "doc_id": chunk.batch.column(0),
        "n_shingles": sizes.astype(np.int64),
        "digest_a": tx.signed(digests[0]),
        "digest_b": tx.signed(digests[1]),
        "signature": [row.tobytes() for row in minima],
    }


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, number of shingles, a 128-bit digest of the shingle set, and the minima, two bytes of each."""
    return tx.map_chunks(tx.documents_of(docs), _sketch, SKETCH)


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.array(batch.column(name).to_pylist()).view("<u2").reshape(batch.num_rows, -1) for name in ("sig_u", "sig_v"))
        yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(1) >= AGREE))


def _sets(chunk: tx.Chunk) -> dict:
    sets, sizes = shingle_sets(chunk)
    return {"u": chunk.batch.column(0), "v": chunk.batch.column(2), "words": tx.ragged(tx.signed(sets), sizes)}


_SETS = EDGES.append(pa.field("words", pa.list_(pa.int64())))


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("words"), batch.column("others"), strict=True)):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            same[i] = 100 * both >= PERCENT * (len(a) + len(b) - both)
        yield batch.select(["u", "v"]).filter(pa.array(same))


def _differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a member's set differs from its leader's: lost and gained shingles, apart by a bit, and how many of the rarest stand for it."""
    for batch in batches:
        rows = {"u": batch.column("u"), "v": batch.column("v"), "component": batch.column("component"), "linked": [], "size": [], "differs": [], "stands": [], "stands_wide": [], "element": []}
        for a, b in zip(batch.column("words"), batch.column("others"), strict=True):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            gained, lost = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
            both = len(a) - len(gained)
            rows["linked"].append(100 * both >= PERCENT * (len(a) + len(lost)))
            # at least floor(least) + 1 differences are common with any link of a member that the leader isn't linked with
            least = (7 * (len(gained) + len(lost)) + len(lost) - len(gained)) // 14
            # and this many with any link of a member that isn't linked with the leader
            wide = max(1, -(-(7 * (len(gained) + len(lost)) - len(a) - len(b)) // 14))
            # a linked set differs in at most a third of len(a), so it has all but so many of the differences
            far = len(gained) + len(lost) - len(a) // 3
            rows["size"].append(len(a))
            rows["differs"].append(len(gained) + len(lost))
            rows["stands"].append(len(gained) + len(lost) - max(least + 1, far) + 1)
            rows["stands_wide"].append(len(gained) + len(lost) - max(wide, far) + 1)
            rows["element"].append(np.concatenate([gained | 1, lost & ~np.int64(1)]))
        yield pa.RecordBatch.from_pydict(rows, schema=_DIFFERENCES)


_DIFFERENCES = EDGES.append(pa.field("component", pa.int64())).append(pa.field("linked", pa.bool_())).append(pa.field("size", pa.int64())).append(pa.field("differs", pa.int64())).append(pa.field("stands", pa.int64())).append(pa.field("stands_wide", pa.int64())).append(pa.field("element", pa.list_(pa.int64())))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of class representatives that are linked. Sets are made from the texts of candidates only."""
    sizes = lambda side: classes.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"sig_{side}"))
    likely = stored(
        pairs.join(sizes("u"), "u")
        .join(sizes("v"), "v")
        .filter(f"100 * least(n_u, n_v) >= {PERCENT} * greatest(n_u, n_v)")
        .select("u", "v", "sig_u", "sig_v")
        .mapInArrow(_agreeing, tx.ddl(EDGES))
    )
    texts = docs.select(F.col("doc_id").alias("u"), "text")
    left = tx.map_chunks(texts.join(likely.hint("merge"), "u").select("u", "text", "v"), _sets, _SETS)
    heads = likely.select(F.col("v").alias("u")).distinct()
    right = tx.map_chunks(texts.join(heads.hint("merge"), "u").select("u", "text", F.col("u").alias("v")), _sets, _SETS)
    return left.join(right.select("v", F.col("words").alias("others")), "v").select("u", "v", "words", "others").mapInArrow(_alike, tx.ddl(EDGES))


def _rest(tested: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The links between members of a bucket that its leader doesn't connect.

    Let v lead, x not be linked with v, and y be another member. With the
    differences of a set from the leader's, x and y can only be linked if they
    have in common more than |diff(y)| / 2 + (lost(y) - gained(y)) / 14 of
    them. So among any |diff(y)| less that number of y's differences there is
    one that x has too, and it is enough to look up y's rarest. In the order of
    rarity the first difference in common is also among x's rarest: as many as
    y's rule leaves if y isn't linked with v either, else all but (|diff(x)| -
    (|x| + |v|) / 7) / 2, since y then differs from v in no more than one
    seventh of both. And linked sets differ in at most a third of either, which
    leaves few differences of a set that is far from v. Edits are mostly a
    copy's own, so little is found in vain, however large the group.
    """
    found = components(edges)
    at = stored(tested.join(found.withColumnRenamed("node", "u"), "u", "left").select("u", "v", F.coalesce("component", "u").alias("component")))
    split = at.groupBy("v").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("v")
    members = stored(at.join(split, "v"))
    active = members.select("u").union(members.select("v")).distinct()
    texts = docs.select(F.col("doc_id").alias("u"), "text")
    sets = stored(tx.map_chunks(texts.join(active.hint("merge"), "u").select("u", "text", F.col("u").alias("v")), _sets, _SETS).select("u", "words"))
    others = sets.select(F.col("u").alias("v"), F.col("words").alias("others"))

    compared = members.join(sets, "u").join(others, "v").select("u", "v", "component", "words", "others").mapInArrow(_differences, tx.ddl(_DIFFERENCES))
    rows = stored(compared.select("v", "u", "component", "linked", "size", "differs", "stands", "stands_wide", F.explode("element").alias("element")))
    # a difference that only members of one component have leads to no new link, however many they are
    common = rows.groupBy("v", "element").agg(F.count("*").alias("n"), (F.min("component") < F.max("component")).alias("mixed")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy("v", "u").orderBy(F.coalesce("n", F.lit(1)), "element"))
    ranked = rows.join(common, ["v", "element"], "left").withColumn("place", place).filter("mixed")
    ranked = stored(ranked.select("v", "element", "u", "component", "linked", "size", "differs", "place", (F.col("place") <= F.col("stands")).alias("standing"), (F.col("place") <= F.col("stands_wide")).alias("wide")))
    theirs = ranked.filter("standing").select("v", "element", F.col("u").alias("w"), F.col("component").alias("other"), F.col("linked").alias("w_linked"), F.col("size").alias("w_size"), F.col("differs").alias("w_differs"), F.col("place").alias("w_place"))
    alike = f"component <> other and 100 * least(size, w_size) >= {PERCENT} * greatest(size, w_size)"
    # were this the first in common, those behind it could still be enough
    enough = "14 * (1 + least(differs - place, w_differs - w_place)) >= 7 * (differs + w_differs) - size - w_size"
    met = ranked.filter("not linked and (standing or wide)").join(theirs, ["v", "element"]).filter(f"{alike} and {enough} and CASE WHEN w_linked THEN wide ELSE standing AND u < w END")
    pairs = met.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct()
    return pairs.join(sets, "u").join(others, "v").select("u", "v", "words", "others").mapInArrow(_alike, tx.ddl(EDGES))


def members_and_leaders(filed: DataFrame) -> DataFrame:
    """The distinct (u, v) of filed(key, u) where v leads a bucket that has u too.

    The leader of a bucket is the member with the most company in all its
    buckets, the smallest of equals. Of the copies of a text, each edited
    elsewhere, this is the text itself, with which all of them are linked.
    """
    shared = stored(filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = stored(filed.join(shared, "key"))
    company = met.groupBy("u").agg(F.sum("n").alias("company"))
    leaders = stored(met.join(company, "u").groupBy("key").agg(F.max(F.struct("company", (-F.col("u")).alias("v"))).alias("top")).select("key", (-F.col("top.v")).alias("v")))
    return stored(met.join(leaders, "key").filter("u <> v").select("u", "v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the group of each document, named by its smallest doc_id, which is kept.

    Two documents are linked if their sets of distinct lower-cased 5-word
    shingles have a Jaccard similarity of 0.75 or more. A text of fewer words
    is one shingle; a null, empty or blank one has none, is linked with nothing
    and kept. Rows that repeat a doc_id are one node that has the links of all
    of them. Rows with a null doc_id have component_id null if no row with an
    id has the same set, and are kept then. Columns other than doc_id and text
    are ignored; an empty table gives no rows.
    """
    docs = tx.documents_of(docs)
    sketched = stored(sketches(docs))
    by_set = ["digest_a", "digest_b", "n_shingles"]
    base = stored(sketched.select("doc_id", *by_set))
    grouped = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy(*by_set).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = stored(grouped)
    forget(sketched)

    band = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(signature, i * {2 * ROWS} + 1, {2 * ROWS}))))")
    tested = members_and_leaders(classes.select(band.alias("key"), F.col("rep").alias("u")))
    edges = stored(confirmed(tested, classes, docs))
    edges = edges.union(_rest(tested, edges, docs))

    found = components(edges)
    named = classes.join(found, classes["rep"] == found["node"], "left").select(*by_set, F.coalesce("component", "rep").alias("component_id"))
    out = base.join(named, by_set, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
