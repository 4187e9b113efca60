"""Near-duplicate classes: ProbMinHash, banding, verification, components.

A document is its distinct runs of ``SHINGLE`` lower-case words, weighted by
1 + ln(count).  ProbMinHash signs it: every shingle is a Poisson process
whose rate is its weight; each arrival falls into a random register, which
keeps the shingle of its first arrival; shingles whose next arrival comes
after the latest register's first are done.  Two documents share a register
with their probability Jaccard similarity.

1. One pass makes a small row per document; copies (equal word sequences, by
   128 bits of md5) become one node.
2. Nodes that share a band meet in its bucket.  Buckets of up to ``SMALL``
   nodes pair all of them.  In a larger one every node is paired with three
   hubs: the node that shares most with others, and two picked by hash.
   Nodes of large buckets that by the count of shingles they share with no
   other such node cannot have a link are left out first (an exact rule), as
   are pairs of too unlike sizes.
3. Pairs are verified on the whole shingle sets (Jaccard >= ``SIMILARITY``),
   which are cut from the texts once: a hub's members are split into salted
   groups, and each group streams with only its hub in memory.
4. Components join verified pairs.  Large buckets whose nodes are not yet in
   one component are dealt again by one more band of the same signatures, so
   that only nodes more alike than the crowd still meet, and go through 2 to
   4 as buckets of their own; ``LEVELS`` times at most, and no more after a
   time that finds no link.  Components that hold together are pairs no more,
   so what is made is linear in a bucket's nodes.
5. The rest is done exactly: nodes of large buckets that still hold several
   components are joined by their rarest shingles (prefixes, with the bound
   that a shingle's place sets), across components only; all pairs that can
   be similar are verified, and their links join components.

So nodes that share a bucket and are similar end in one class whatever the
bucket's size; a link is lost only if its nodes share none of the bands.

Intermediate tables are written to the shared checkpoint folder.  Defined
results: texts without words are copies if equal; NULL texts are empty;
documents of fewer words than a shingle have one shingle of all their words;
NULL ids belong to classes like others, whose id is the least id that is not
NULL; repeated rows are copies (``keep_one`` keeps one of them); an empty
table gives an empty table; a long text is one row with its whole shingle
set.  Columns of other names are never read by ``classes`` and all kept by
``keep_one``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import CACHES, rows_of
from textlab.session import scratch_dir, ship_package

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares none of these bands once in 20,000 times.
BANDS, ROWS = 25, 5
#: Nodes up to which a bucket pairs all of them; groups of a hub's members.
SMALL, SALTS = 8, 256
#: Bands that buckets are dealt by, one more each time.
LEVELS = 5
#: Nodes of one shingle that are paired in one group, about.
BLOCK = 512

_WORD = re.compile(r"[^\W_]+")
_WORDS: dict[str, int] = {}  # hashes of words, for each Python worker, which keeps them between stages
MAX_WORDS = 50_000
CACHES.append(_WORDS)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    if len(_WORDS) > MAX_WORDS:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    if not n:
        return h, np.empty(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MIX + h[k:len(h) - n + 1 + k]
    return np.unique(_mixed(out + np.uint64(n)), return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of several documents (each with a shingle at least): documents x registers of shingles."""
    x = np.concatenate([s for s, _ in docs])
    rate = 1 + np.log(np.concatenate([n for _, n in docs]))
    doc = np.repeat(np.arange(len(docs)), [len(s) for s, _ in docs])
    first = np.full(len(docs) * registers, np.inf)
    sample = np.zeros(len(docs) * registers, np.uint64)
    time, arrival = np.zeros(len(x)), 0
    while len(x):
        arrival += 1
        h = _mixed(x + np.uint64(arrival * int(_MIX) % 2**64))
        time = time - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        at = doc * registers + (_mixed(h) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sample[at[won]] = x[won]
        going = time < first.reshape(-1, registers).max(1)[doc]  # later arrivals of the others change nothing
        x, rate, doc, time = x[going], rate[going], doc[going], time[going]
    return sample.reshape(-1, registers)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """documents x bands of 64-bit bucket numbers."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, parts.shape[:2])
    for k in range(ROWS):
        out = _mixed(out * _MIX + parts[:, :, k])
    return out.view(np.int64)


def key_of(words: list[str], text: str) -> bytes:
    """What copies have in common, in 128 bits."""
    return hashlib.md5((" ".join(words) if words else "\0" + text).encode()).digest()


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, key, size, bands) of every row; size: distinct shingles; no bands without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 64):
            words = [words_of(t) for t in rows["text"]]
            keys = [key_of(w, t) for w, t in zip(words, rows["text"])]
            with_words = [k for k, w in enumerate(words) if w]
            bands: list = [[]] * len(words)
            sizes = [0] * len(words)
            if with_words:
                sets = [shingles(words[k]) for k in with_words]
                for k, own, b in zip(with_words, sets, bands_of(signatures(sets))):
                    bands[k], sizes[k] = b, len(own[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["text_hash"], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "key", "size", "bands"])

    ship_package(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text_hash long, key binary, size int, bands array<long>")


def _short(text: str) -> np.ndarray:
    """Distinct shingle hashes of 32 bits, ascending."""
    return np.unique(shingles(words_of(text))[0] >> np.uint64(32)).astype("<u4")


def _sets(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, own) of ``some`` distinct nodes: their shingle sets, from the text of each node's representative.
    Texts are moved here and nowhere else."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 128):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["node"], pa.int64()), pa.array([_short(t).tobytes() for t in rows["text"]], pa.binary())],
                names=["node", "own"])

    rep = some.join(nodes, "node").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    same = (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    texts = docs.hint("merge").join(rep, same).select("node", "text")  # one way at every size
    return _written(texts.mapInArrow(cut, "node long, own binary").dropDuplicates(["node"]), "sets")


def _listed(own: DataFrame, *keep: str) -> DataFrame:
    """(*keep, shingle) of every shingle of the sets in ``own``; what is kept are columns of longs."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 128):
            each = [np.frombuffer(raw, "<u4").astype(np.int64) for raw in rows["own"]]
            long = [len(x) for x in each]
            flat = [*(np.repeat(np.array(rows[c], np.int64), long) for c in keep), np.concatenate(each)]
            for k in range(0, len(flat[-1]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 16)]) for x in flat], names=[*keep, "shingle"])

    return own.mapInArrow(listed, ", ".join(f"{c} long" for c in [*keep, "shingle"]))


def _linkable(sets: DataFrame, some: DataFrame) -> DataFrame:
    """Those of ``some`` distinct nodes that may be similar to another of them.

    A node's similarity to any other is at most the share of its shingles that another node has too, so
    one with more than 1 - ``SIMILARITY`` shingles of its own has no link: an exact rule, not an estimate.
    """
    own = sets.join(some, "node")
    single = (_listed(own, "node").groupBy("shingle")
              .agg(F.count("*").alias("k"), F.min("node").alias("node")).filter("k = 1"))
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    return (own.select("node", (F.octet_length("own") / 4).alias("n")).join(alone, "node", "left")
            .filter(F.coalesce("alone", F.lit(0)) <= F.col("n") * (1 - SIMILARITY) + 1e-9).select("node"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct (member, hub) pairs whose shingle sets are similar enough; hashes of 32 bits."""
    # a hub's members are spread over SALTS groups, most of which are empty for most hubs
    members = pairs.select(F.col("member").alias("node"), "hub", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int").alias("salt"),
                           F.lit(True).alias("is_member"))
    own = members.select(F.col("hub").alias("node"), "hub", "salt", F.lit(False).alias("is_member")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.empty(0, "<u4")
        for rows in rows_of(batches, 128):
            good = ([], [])
            for h, salt, is_member, node, raw in zip(*(rows[c] for c in ("hub", "salt", "is_member", "node", "own"))):
                mine = np.frombuffer(raw, "<u4")
                if not is_member:  # sorted before its group's members
                    at, hub = (h, salt), mine
                elif at == (h, salt):
                    both = len(np.intersect1d(hub, mine, assume_unique=True))
                    if both >= SIMILARITY * (len(hub) + len(mine) - both):
                        good[0].append(node)
                        good[1].append(h)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in good], names=["member", "hub"])

    found = sets.join(members.unionByName(own), "node").select("hub", "salt", "is_member", "node", "own")
    return (found.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "is_member")
            .mapInArrow(verify, "member long, hub long"))


def _components(links: DataFrame) -> DataFrame:
    """(node, component): the least node each node is linked to, by label propagation with pointer jumping."""
    both = _written(links.select(F.col("member").alias("node"), F.col("hub").alias("other"))
                    .unionByName(links.select(F.col("hub").alias("node"), F.col("member").alias("other"))), "links")
    label = _written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = (both.join(label.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        new = label.join(near, "node").select("node", F.col("component").alias("old"),
                                              F.least("component", "near").alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = _written(new.join(up, "component").select("node", "old", F.least("component", "higher").alias("component")),
                       "labels")
        label = new.select("node", "component")
        if new.filter("component != old").isEmpty():
            return label


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` with further links between nodes: only the components that they touch are joined anew."""
    ends = component.select(F.col("node").alias("n"), F.col("component").alias("c"))
    for side in ("member", "hub"):
        links = links.join(ends, F.col(side) == F.col("n"), "left").withColumn(side, F.coalesce("c", side)).drop("n", "c")
    merged = _components(links.filter("member != hub").distinct())
    merged = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = component.join(merged, F.col("component") == F.col("old"), "left").select(
        "node", F.coalesce("new", "component").alias("component"))
    fresh = merged.join(component, F.col("old") == F.col("node"), "left_anti").select(
        F.col("old").alias("node"), F.col("new").alias("component"))
    return _written(known.unionByName(fresh), "component")


_NODE = ("node", "size", "strength")


def _fits(a: Column, b: Column) -> Column:
    """Sets of too unlike sizes cannot be similar; the hundredth allows for hashes that meet."""
    return F.least(a, b) >= F.greatest(a, b) * (SIMILARITY - 0.01)


def _pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify, and the rows of the buckets that have more than ``SMALL`` nodes and several components.

    ``buckets``: (bucket, b, node, size, strength, component, bands).  Nodes of one component are no pair.
    """
    sizes = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.max(F.struct("strength", "node", "size", "component")).alias("h0"),
        F.max(F.struct(F.xxhash64("node").alias("r"), "node", "size", "component")).alias("h1"),
        F.min(F.struct(F.xxhash64("node").alias("r"), "node", "size", "component")).alias("h2")).filter("n > 1 and lo < hi")
    rows = buckets.join(sizes.select("bucket", "n", "h0", "h1", "h2"), "bucket")
    lists = rows.filter(F.col("n") <= SMALL).groupBy("bucket").agg(
        F.sort_array(F.collect_set(F.struct("node", "size", "component"))).alias("all"))
    each = lists.select("all", F.posexplode("all").alias("k", "x"))
    all_pairs = each.select(F.explode(F.slice("all", F.col("k") + 2, SMALL)).alias("x"), F.col("x").alias("y"))
    hubs = F.array(*[F.struct(*[F.col(f"{h}.{c}").alias(c) for c in ("node", "size", "component")]) for h in ("h0", "h1", "h2")])
    stars = rows.filter(F.col("n") > SMALL).select(F.struct("node", "size", "component").alias("x"), F.explode(hubs).alias("y"))
    both = all_pairs.unionByName(stars).filter(
        (F.col("x.component") != F.col("y.component")) & _fits(F.col("x.size"), F.col("y.size")))
    return (both.select(F.col("x.node").alias("member"), F.col("y.node").alias("hub")).distinct(),
            rows.filter(F.col("n") > SMALL).select("bucket", "b", *_NODE, "bands"))


def _unsettled(crowded: DataFrame, component: DataFrame) -> DataFrame:
    """(node, component) of the nodes of those large buckets that still hold several components."""
    now = crowded.select("bucket", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return now.join(several.select("bucket"), "bucket").select("node", "component").distinct()


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the groups (shingle, lo, hi) in which they are paired and the block that they are in there.

    A shingle of up to ``BLOCK`` nodes is one group.  The nodes of others are dealt over blocks, and every two
    blocks are a group, as is each block itself.  A component of more nodes than that has blocks of its own,
    which never meet each other.
    """
    sizes = rows.groupBy("shingle").agg(F.count("*").alias("k"))
    crowded = F.broadcast(sizes.filter(F.col("k") > BLOCK).select("shingle"))  # a number for more than BLOCK rows each
    one = F.lit(0).cast("long")
    few = rows.join(crowded, "shingle", "left_anti").select("*", one.alias("block"), one.alias("lo"), one.alias("hi"))
    hot = rows.join(crowded, "shingle")
    parts = hot.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    mixed = parts.filter(F.col("k") <= BLOCK).groupBy("shingle").agg(F.sum("k").alias("mixed"))
    large = F.col("k") > BLOCK

    def slot(col: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(col), F.ceil(n / BLOCK))

    hot = hot.join(parts, ["shingle", "component"]).join(mixed, "shingle", "left").select(
        *rows.columns, F.when(large, F.xxhash64("component", slot("node", F.col("k"))))
        .otherwise(slot("component", F.col("mixed"))).alias("block"), F.when(large, F.col("component")).alias("only"))
    blocks = hot.select("shingle", "block", "only").distinct()
    other = blocks.select("shingle", F.col("block").alias("other"), F.col("only").alias("other_only"))
    meet = blocks.join(other, "shingle").filter(
        F.col("only").isNull() | F.col("other_only").isNull() | (F.col("only") != F.col("other_only")))
    meet = meet.select("shingle", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).distinct()
    return few.unionByName(hot.drop("only").join(meet, ["shingle", "block"]))


def _candidates(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(member, hub) of all pairs of ``rest`` (distinct node, component) in different components that can be similar.

    Shingles are ordered: those of one component's nodes first, then by the number of nodes, then by themselves.
    All shingles that two sets share follow their first common one, which so has at least as many shingles from it on in
    both sets as a similar pair must share: SIMILARITY / (1 + SIMILARITY) of both sizes, and that is SIMILARITY of the
    larger at least.  So only a set's first shingles are joined, and pairs go by the places of those they share.
    """
    own = sets.join(rest, "node").withColumn("n", (F.octet_length("own") / 4).cast("long"))
    each = _listed(own, "node", "component", "n")
    # a shingle that one component has to itself is in no pair, but has its place: before all others
    shared = each.groupBy("shingle").agg(F.count("*").alias("k"), F.min("component").alias("lo"),
                                         F.max("component").alias("hi")).filter("lo < hi").select("shingle", "k")
    following = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), F.desc("shingle")))
    first = each.join(shared, "shingle").withColumn("following", following.cast("long")).drop("k")
    first = _written(first.filter(F.col("following") >= F.col("n") * SIMILARITY - 1e-6), "prefixes")
    dealt = _written(_in_blocks(first), "dealt")
    x, y = (dealt.filter(F.col("block") == F.col(side)).select(
        "shingle", "lo", "hi", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "n", "following")])
        for side in ("lo", "hi"))
    enough = (F.col("n_lo") + F.col("n_hi")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    both = x.join(y, ["shingle", "lo", "hi"]).filter(
        ((F.col("lo") < F.col("hi")) | (F.col("node_lo") < F.col("node_hi"))) & (F.col("component_lo") != F.col("component_hi"))
        & (F.least("following_lo", "following_hi") >= enough))
    return both.select(F.least("node_lo", "node_hi").alias("member"), F.greatest("node_lo", "node_hi").alias("hub")).distinct()


def _links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    rows = nodes.select("node", "size", F.posexplode("bands").alias("b", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = _written(rows.join(sizes, "bucket"), "members")
    sets = _sets(members.select("node").distinct(), nodes.select("node", "rep"), docs)
    crowd = members.filter(F.col("n") > SMALL)
    strength = crowd.groupBy("node").agg(F.sum("n").alias("strength"))
    linkable = _linkable(sets, strength.select("node")).join(strength, "node").join(nodes.select("node", "bands"), "node")
    large = _written(crowd.select("bucket", "b", "node", "size").join(linkable, "node"), "large")
    few = members.filter(F.col("n") <= SMALL).select(
        "bucket", "b", "node", "size", F.lit(0).cast("long").alias("strength"), F.lit(None).cast("array<long>").alias("bands"))
    alone = F.col("node").alias("component")  # at first every node is a component
    pairs, left = _pairs(large.unionByName(few).select("*", alone))
    pairs = _written(pairs, "pairs")
    left = crowded = _written(left, "left")
    links = _written(_verified(pairs, sets), "links")
    component = _components(links)
    for level in range(1, LEVELS):
        # dealt again: the next band of the same signature is added to what a bucket's nodes share
        following = F.get("bands", F.pmod(F.col("b") + level, F.lit(BANDS)).cast("int"))
        again = left.withColumn("bucket", F.xxhash64("bucket", following))
        again = again.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        new, left = _pairs(again.select("bucket", "b", *_NODE, "component", "bands"))
        new = _written(new.join(pairs, ["member", "hub"], "left_anti"), "pairs")
        left = _written(left, "left")
        pairs = pairs.unionByName(new)
        more = _written(_verified(new, sets), "links")
        if more.isEmpty():
            break  # buckets that hold several components still do, and so would be left for the exact step
        component = _joined(component, more)
        if left.isEmpty():
            break
    rest = _written(_unsettled(crowded, component), "rest")
    if rest.isEmpty():
        return component
    known = pairs.select(F.least("member", "hub").alias("member"), F.greatest("member", "hub").alias("hub"))
    more = _written(_verified(_written(_candidates(rest, sets).join(known, ["member", "hub"], "left_anti"), "pairs"), sets), "links")
    return component if more.isEmpty() else _joined(component, more)


def _least(doc_id: Column, text_hash: Column) -> Column:
    """A document's place among the copies: ids that are not NULL first."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), text_hash.alias("text_hash"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and (key, node, rep, copies, class_rep, class_size) of every node."""
    signed = _written(sign(docs, id_col, text_col), "signed")
    nodes = signed.groupBy("key").agg(
        F.min(_least(F.col("doc_id"), F.col("text_hash"))).alias("rep"), F.count("*").alias("copies"),
        F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    # numbered as they are written, so a node is 64 bits from here on and no two share a number
    nodes = _written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    component = _links(nodes, _rows(docs, id_col, text_col))
    own = nodes.select("key", "node", "rep", "copies").join(component, "node", "left")
    own = _written(own.withColumn("component", F.coalesce("component", "node")), "classes")
    whole = own.groupBy("component").agg(F.min("rep").alias("class_rep"), F.sum("copies").alias("class_size"))
    return signed.select("doc_id", "text_hash", "key"), own.join(whole, "component")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) of every row; ``class_id`` is the least doc_id of the class."""
    signed, nodes = _classes(docs, id_col, text_col)
    nodes = nodes.select("key", F.col("class_rep.doc_id").alias("class_id"), "class_size")
    return signed.select("doc_id", "key").join(nodes, "key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the least id (NULL ids last); of repeated rows any one.
    NULL texts count as empty; an empty table stays empty."""
    signed, nodes = _classes(docs, id_col, text_col)
    kept = _written(nodes.select("class_rep.doc_id", "class_rep.text_hash").distinct(), "kept")
    own = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    same = (own == kept["text_hash"]) & docs[id_col].cast("long").eqNullSafe(kept["doc_id"])
    repeated = signed.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if repeated.isEmpty():
        return docs.join(kept, same, "left_semi")
    # rows of one id and text, which may differ in other columns: whole rows are grouped, so no name can clash
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("doc_id"),
                        own.alias("text_hash"))
    same = (F.col("text_hash") == F.col("kept_hash")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    whole = whole.join(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")), same, "left_semi")
    return whole.groupBy("doc_id", "text_hash").agg(F.any_value("row").alias("row")).select("row.*")
