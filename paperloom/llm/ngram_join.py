"""N-gram Jaccard join over a token-group matrix.

Documents that resemble each other are put into groups, each group keeps the
union of its members' shingles as rows (shingle, group), and a document looks
only into groups whose union holds enough of its shingles.

1. One scan gives every document the size and two fingerprints of its shingle
   set. Equal sets are one node from here on.
2. Shingles in the order of their hashes: two sets that link hold their first
   m common shingles within the first `spare + m` of each, where spare is the number
   a set can miss. These leading shingles, with m a sixth of the set, are grouped by
   shingle; nodes that share too few of theirs with other nodes are done. What stays
   is hardly more than near copies. A task emits those of equal sets once.
3. The others get their whole sets and are grouped: minhash bands propose to each
   node the leader that it shares most bands with, exact Jaccard confirms, and
   components of confirmed links are the groups. Nodes that step 4 leaves over try
   again with neighbours in their bands, so that families of loose copies join too.
4. A node with too many shingles that no *other* group holds has no partner
   outside its group and retires, first by a sample of shingles (those below a
   fixed hash value, so the bound holds), then by whole sets.
5. For the rest the matrix (shingle, group) finds the candidates: shingles are
   ordered by the number of groups that hold them, and prefixes meet group by group,
   with bounds on the sizes and on what members share with other groups at all (the
   smaller of two sets that link shows itself in a shorter prefix). Of two groups the
   members of the smaller ask; the overlap of each with the other group's union is
   counted, and only groups whose overlap reaches the bound are opened: block by
   block, members and askers meet in one task, which returns links and nothing else.
   As members of a group are linked already, a large group of near copies costs one
   question of each stray node.

Every comparison that decides a link is exact on 64-bit shingle hashes; the
minhash bands only save work, and prefix, length and overlap bounds lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import bytetext as bt
from paperloom.llm.components import connected_components
from paperloom.llm.workspace import Workspace

#: Share of all hash values whose shingles make the sample.
SAMPLE = 0.3
BELOW = int(-(2**63) + SAMPLE * 2**64)
BANDS, ROWS = 12, 3
#: Further rounds of grouping, and nodes of one band that elect a neighbour together.
AGAIN, TOGETHER = 2, 4
#: Bounds on a block of an opened group or of its askers.
BLOCK_NODES, BLOCK_TOKENS = 512, 1 << 20
#: One in so many shingles is to be found in common among the leading ones.
MORE = 6
_U = np.uint64


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    raw, offsets = bt.buffers(batch.column(1))
    for lo, hi in bt.blocks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        hashes, at = bt.words(part, offsets[lo : hi + 1] - offsets[lo])
        values, slot = bt.shingle_sets(hashes, at, k)
        u = values.view(_U)
        f1 = bt.row_sums(bt.mix(u ^ _U(0x9E3779B97F4A7C15)), slot)
        f2 = bt.row_sums(bt.mix(u + _U(0x632BE59BD9B4E019)), slot)
        yield batch.column(0).slice(lo, hi - lo), values, slot, bt.mix(f1 + np.diff(slot).astype(_U)).view(np.int64), f2.view(np.int64)


def _features(k: int):
    def run(batches):
        for batch in batches:
            lo = 0
            for ids, _, slot, f1, f2 in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(lo, len(ids)), pa.array(np.diff(slot)), pa.array(f1), pa.array(f2)], ["doc", "row", "n", "node", "twin"])
                lo += len(ids)

    return run


def _leading(k: int, num: int, den: int):
    """(token, node): the leading shingles of every set, once a task."""

    def run(batches):
        told: set[int] = set()  # nodes of this task: as many as its rows at most
        for batch in batches:
            for _, values, slot, f1, _ in _sets(batch, k):
                fresh = np.zeros(len(f1), bool)
                for i, node in enumerate(f1.tolist()):
                    fresh[i] = node not in told
                    told.add(node)
                size = np.diff(slot)
                wanted = np.where(fresh, np.minimum(size, size * (den - num) // den + 1 + size // MORE), 0)
                token = values[np.repeat(slot[:-1], wanted) + np.arange(wanted.sum()) - np.repeat(np.cumsum(wanted) - wanted, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(f1, wanted))], ["token", "node"])

    return run


def _shared(batches):
    """(node, hits): how many tokens other nodes hold too, from rows sorted by token and node."""
    held, told = None, False  # the last row so far, and whether its token is shared
    for batch in batches:
        token, node = (np.asarray(batch.column(i)) for i in range(2))
        if not len(token):
            continue
        if held is not None:
            token, node = np.concatenate(([held[0]], token)), np.concatenate(([held[1]], node))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node = token[new], node[new]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(begin, len(token)))
        many = count > 1
        many[0] |= told
        out = np.repeat(many, count)
        if told:
            out[0] = False  # counted with the batch before
        nodes, hits = np.unique(node[out], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(hits)], ["node", "hits"])
        held, told = (token[-1], node[-1]), bool(many[-1])


def _bands(values: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """One key for each row and band: the smallest hashes under ROWS functions."""
    rows = len(slot) - 1
    keys = np.zeros((rows, BANDS), np.int64)
    full = np.diff(slot) > 0
    u = values.view(_U)
    for b in range(BANDS):
        key = np.full(rows, (b + 1) * 0xA24BAED4963EE407 & (2**64 - 1), _U)
        for r in range(ROWS):
            seed = _U(((b * ROWS + r + 1) * 0x9FB21C651E98DF25) & (2**64 - 1))
            h = (u ^ seed) * _U(0xC2B2AE3D27D4EB4F)
            h ^= h >> _U(29)
            low = np.zeros(rows, _U)
            if len(h):
                low[full] = np.minimum.reduceat(h, slot[:-1][full])
            key = bt.mix(key + low)
        keys[:, b] = key.view(np.int64)
    return keys


def _whole(k: int):
    """The whole set and the bands of every row whose set is the wanted one."""

    def run(batches):
        for batch in batches:
            lo = 0
            for ids, values, slot, f1, f2 in _sets(batch, k):
                node, twin = (np.asarray(batch.column(i).slice(lo, len(ids))) for i in (2, 3))
                names = batch.column(4).slice(lo, len(ids))
                lo += len(ids)
                asked = (node == f1) & (twin == f2)
                values, size = values[np.repeat(asked, np.diff(slot))], np.diff(slot)[asked]
                slot = np.concatenate(([0], np.cumsum(size)))
                keys = _bands(values, slot)
                yield pa.RecordBatch.from_arrays(
                    [names.filter(pa.array(asked)), pa.array(size), bt.lists(values, slot), pa.array(bt.row_sums((values < BELOW).astype(np.int64), slot)), bt.lists(keys.ravel(), np.arange(len(keys) + 1) * keys.shape[1])],
                    ["id", "n", "tokens", "n_sample", "bands"],
                )

    return run


def _links(num: int, den: int):
    """The groups of the askers that link with a member, and the members' group, once a block."""

    def run(members: pa.Table, askers: pa.Table) -> pa.Table:
        n, token = members.column("n").to_numpy(), members.column("tokens").combine_chunks().flatten().to_numpy()
        owner, found = np.repeat(np.arange(len(n)), n), set()
        for home, na, own in zip(askers.column("home").to_pylist(), askers.column("size").to_pylist(), askers.column("own")):
            if home in found:
                continue
            own = own.values.to_numpy()  # sorted
            at = np.minimum(np.searchsorted(own, token), len(own) - 1)
            shared = np.bincount(owner[own[at] == token], minlength=len(n))
            if (shared * den >= (n + na - shared) * num).any():
                found.add(home)
        there = members.column("g")[0].as_py() if found else None
        return pa.table({"a": list(found), "b": [there] * len(found)}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


class _Join:
    """One run: the steps as methods, so that what a step planned goes out of scope with it."""

    def __init__(self, spark: SparkSession, docs: DataFrame, words: int, num: int, den: int):
        self.ws, self.docs, self.words, self.num, self.den = Workspace(spark, "ngram-join"), docs, words, num, den
        self.spare = f"(n * {den - num} DIV {den})"

    def nodes(self, feat: DataFrame) -> DataFrame:
        """(id, node, twin, n, rep, open) of the distinct sets; open ones share enough leading shingles with others."""
        near = self.docs.where("doc IS NOT NULL").select("doc", "text").mapInArrow(_leading(self.words, self.num, self.den), "token long, node long")
        near = near.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared, "node long, hits long").groupBy("node").agg(F.sum("hits").alias("hits"))
        sets = feat.where("n > 0 AND doc IS NOT NULL").groupBy("node", "twin", "n").agg(F.min("doc").alias("rep"))
        # two sets with one fingerprint get ids of their own
        nth = F.row_number().over(Window.partitionBy("node").orderBy("twin", "n")) - 1
        sets = sets.withColumn("id", F.col("node").bitwiseXOR(nth.cast("long")))
        # a partner may be smaller, down to the threshold, and shows fewer of its own
        least = f"1 + ((n * {self.num} + {self.den - 1}) DIV {self.den}) DIV {MORE}"
        return self.ws.save(sets.join(near, "node", "left").select("id", "node", "twin", "n", "rep", F.coalesce(F.expr(f"hits >= {least}"), F.lit(False)).alias("open")), "nodes")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(id, n, tokens, n_sample, bands) of the open nodes."""
        wanted = nodes.where("open").select(F.col("rep").alias("doc"), "node", "twin", "id")
        whole = self.docs.select("doc", "text").join(wanted, "doc").mapInArrow(_whole(self.words), "id long, n long, tokens array<long>, n_sample long, bands array<long>")
        found = self.ws.save(whole, "whole")
        ids = found.select("id")
        if ids.count() == ids.distinct().count():
            return found
        once = self.ws.save(found.groupBy("id").agg(*(F.first(c).alias(c) for c in found.columns if c != "id")), "once")  # repeated rows of a representative
        self.ws.drop("whole")
        return once

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs(a, b, ...) of nodes whose sets reach the threshold."""
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        return (
            pairs.join(left, "a")
            .join(right, "b")
            .where(f"least(na, nb) * {self.den} >= greatest(na, nb) * {self.num}")
            .withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long"))
            .where(f"shared * {self.den} >= (na + nb - shared) * {self.num}")
            .select(*pairs.columns)
        )

    def proposed(self, sets: DataFrame) -> DataFrame:
        """(a, b): each node and the leader that it shares most bands with."""
        keyed = sets.select("id", F.explode("bands").alias("key"))
        leads = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", "lead")
        votes = keyed.join(leads, "key").where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("votes"))
        best = votes.groupBy("id").agg(F.max(F.struct("votes", "lead")).alias("best"))
        return best.select(F.col("id").alias("a"), F.col("best.lead").alias("b"))

    def grouped(self, sets: DataFrame) -> DataFrame:
        """(node, label) of the groups that bands propose and exact Jaccard confirms."""
        return connected_components(self.ws, self.linked(self.proposed(sets), sets), "groups")

    def rest(self, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """(id, n, g, tokens, bands) of the nodes that may have a partner outside their group g."""
        sets = sets.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("label", "id").alias("g"), "tokens", "bands", "n_sample")
        fewer = self.without_partners(sets.select("id", "n", "g", F.expr("slice(tokens, 1, cast(n_sample as int))").alias("tokens")))
        some = self.ws.save(sets.join(fewer, "id", "left_anti").drop("n_sample"), "some")
        last = self.ws.save(some.join(self.without_partners(some), "id", "left_anti"), "last")
        self.ws.drop("some")
        return last

    def neighbours(self, sets: DataFrame, r: int) -> DataFrame:
        """(a, b, ga, gb): each node and, of every band, one of the few nodes of other groups that it is put together with; and their groups."""
        keyed = sets.select("id", "g", F.explode("bands").alias("key"))
        crowd = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / TOGETHER).alias("seats"))
        seated = keyed.join(crowd, "key").withColumn("seat", F.pmod(F.xxhash64("id", F.lit(r)), F.col("seats")))
        leads = seated.groupBy("key", "seat").agg(F.min(F.struct(F.xxhash64("id", F.lit(-r)).alias("h"), F.col("id").alias("lead"), F.col("g").alias("lg"))).alias("l"))
        return seated.join(leads, ["key", "seat"]).where("g <> l.lg").select(F.col("id").alias("a"), F.col("l.lead").alias("b"), F.col("g").alias("ga"), F.col("l.lg").alias("gb")).distinct()

    def regrouped(self, last: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """last after further rounds of grouping, and the (node, label) that each round gave to groups that joined others."""
        moves = []
        for r in range(1, AGAIN + 1):
            fresh = self.linked(self.neighbours(last, r), last).select(F.col("ga").alias("a"), F.col("gb").alias("b"))
            moved = connected_components(self.ws, fresh, f"moves_{r}")
            if not moved.limit(1).count():
                break
            moves.append(moved)
            named = self.ws.save(last.join(moved.withColumnRenamed("node", "g"), "g", "left").withColumn("g", F.coalesce("label", "g")).drop("label"), f"named_{r}")
            last = self.ws.save(named.join(self.without_partners(named), "id", "left_anti"), f"last_{r}")
            self.ws.drop(f"named_{r}")
        return last, moves

    def without_partners(self, sets: DataFrame) -> DataFrame:
        """Nodes with too many shingles that no other group holds."""
        rows = sets.select("id", "g", F.explode("tokens").alias("token"))
        own = rows.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo = hi").select("token")
        count = rows.join(own, "token").groupBy("id").agg(F.count("*").alias("own"))
        return count.join(sets.select("id", "n"), "id").where(f"own > {self.spare}").select("id")

    def prefixes(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The matrix (token, g), and (id, n, own, g, token, place) of the nodes' rarest tokens that several groups hold."""
        rows = sets.select("id", "n", "g", F.explode("tokens").alias("token"))
        matrix = self.ws.save(rows.select("token", "g").distinct(), "matrix")
        held = matrix.groupBy("token").agg(F.count("*").alias("df"))
        by_node = Window.partitionBy("id")
        ranked = rows.join(held, "token").withColumns({"place": F.row_number().over(by_node.orderBy("df", "token")), "own": F.sum((F.col("df") == 1).cast("long")).over(by_node)})
        return matrix, self.ws.save(ranked.where(f"place <= {self.spare} + 1 AND df > 1").select("id", "n", "own", "g", "token", "place"), "prefix")

    def asked(self, sets: DataFrame, prefix: DataFrame) -> DataFrame:
        """(a, n, g, members): nodes and the groups that may hold a partner, by prefixes, sizes and shared tokens."""
        num, den = self.num, self.den
        room = F.max(F.col("n") - F.col("own")).alias("room")
        # of a pair, the smaller set shows a common token in its first n - 2 num n / (num + den) + 1, the larger in its whole prefix
        index = prefix.where(f"place <= n - (2 * n * {num} + {num + den - 1}) DIV {num + den} + 1").groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), room)
        probe = prefix.groupBy("token", "g").agg(F.min("n").alias("p_lo"), F.max("n").alias("p_hi"), room.alias("p_room")).withColumnRenamed("g", "p")
        sized = f"lo <= p_hi AND hi * {den} >= p_lo * {num}"
        fits = f"least(room, p_room) * {num + den} >= (lo + greatest(lo, p_lo)) * {num}"
        pairs = index.join(probe, "token").where("g <> p").where(sized).where(fits).select(F.least("g", "p").alias("x"), F.greatest("g", "p").alias("y")).distinct()
        members = sets.groupBy("g").agg(F.count("*").alias("members"))
        for c in "xy":
            pairs = pairs.join(members.select(F.col("g").alias(c), F.col("members").alias(f"m{c}")), c)
        turned = F.col("mx") <= F.col("my")
        asks = pairs.select(F.when(turned, F.col("x")).otherwise(F.col("y")).alias("own"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("g"), F.greatest("mx", "my").alias("members"))
        return self.ws.save(asks.join(sets.select(F.col("id").alias("a"), "n", F.col("g").alias("own")), "own").select("a", "n", "g", "members"), "asked")

    def qualified(self, sets: DataFrame, matrix: DataFrame, asked: DataFrame) -> DataFrame:
        """(a, g): the questions whose node has enough tokens in the group's union; of a single member its comparison decides."""
        held = (
            asked.where("members > 1").join(sets.select(F.col("id").alias("a"), "tokens"), "a")
            .select("a", "n", "g", F.explode("tokens").alias("token"))
            .join(matrix, ["token", "g"])
            .groupBy("a", "n", "g").agg(F.count("*").alias("both"))
            .where(f"both * {self.den} >= n * {self.num}")
        )
        return self.ws.save(held.select("a", "g").unionByName(asked.where("members = 1").select("a", "g")), "qualified")

    def opened(self, sets: DataFrame, asks: DataFrame) -> DataFrame:
        """(a, b): groups of which an asker of the one links with a member of the other."""
        cuts = lambda size, name: F.expr(f"cast(greatest(ceil(count(*) / {BLOCK_NODES}), ceil(sum({size}) / {BLOCK_TOKENS})) as int)").alias(name)
        members = sets.select("g", F.col("id").alias("node"), "n", "tokens")
        asks = asks.join(sets.select(F.col("id").alias("a"), F.col("g").alias("home"), F.col("n").alias("size"), F.col("tokens").alias("own")), "a").select("g", F.col("a").alias("asker"), "home", "size", "own")
        # a table of its own, so that a group with many members meets it in several tasks
        shape = self.ws.save(members.groupBy("g").agg(cuts("n", "rows")).join(asks.groupBy("g").agg(cuts("size", "cols")), "g"), "shape")
        spread = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
        place = lambda c, x: F.pmod(F.xxhash64(c), F.col(x)).cast("int")
        left = members.join(shape, "g").select("g", place("node", "rows").alias("i"), spread("cols").alias("j"), "n", "tokens")
        right = asks.join(shape, "g").withColumn("j", place("asker", "cols")).select(F.col("g").alias("g2"), spread("rows").alias("i2"), F.col("j").alias("j2"), "home", "size", "own")
        return left.groupBy("g", "i", "j").cogroup(right.groupBy("g2", "i2", "j2")).applyInArrow(_links(self.num, self.den), "a long, b long")

    def across(self, sets: DataFrame) -> DataFrame:
        matrix, prefix = self.prefixes(sets)
        return self.opened(sets, self.qualified(sets, matrix, self.asked(sets, prefix)))

    def classes(self) -> DataFrame:
        """(doc, row, n, component) for every row: the class's smallest node, null without shingles or id."""
        ws = self.ws
        feat = ws.save(self.docs.mapInArrow(_features(self.words), "doc long, row long, n long, node long, twin long"), "features")
        nodes = self.nodes(feat)
        ws.settle()  # the leading shingles are more than everything that follows
        sets = self.sets(nodes)
        labels = self.grouped(sets)
        ws.settle()
        last, moves = self.regrouped(self.rest(sets, labels))
        ws.settle()
        moves.append(connected_components(ws, self.across(last), "final"))
        labels = sets.select(F.col("id").alias("node")).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        for moved in moves:  # what a group was named at first leads to its last name
            labels = labels.join(moved.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        named = ws.save(nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("node", "twin", "n", "rep", F.coalesce("label", "id").alias("component")), "named")
        ws.drop("nodes", "whole", "once", "last", "matrix", "prefix", "asked", "qualified", "shape", *(f"last_{r}" for r in range(1, AGAIN + 1)))
        ws.settle()
        smallest = named.groupBy("component").agg(F.min("rep").alias("least"))
        of = named.join(smallest, "component").select("node", "twin", "n", "component", "least")
        wide = feat.alias("f").join(of.alias("o"), F.expr("f.node = o.node AND f.twin = o.twin AND f.n = o.n AND f.doc IS NOT NULL"), "left")
        return wide.select("f.doc", "f.row", "f.n", "o.component", "o.least")


def _rows(docs: DataFrame, id_col: str, text_col: str, row) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), row.cast("long").alias("row"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two documents link when shared * den >= num * size of the union of their sets
    of `words`-word shingles (A-Z lower-cased, words between ASCII white space).
    component_id is the smallest id reachable by links. Null and empty texts, and
    those of white space only, have no shingles and are linked with nothing.
    Rows with the same id are told apart by their text; a row whose id is null
    is returned with its size and without a component. Other columns of docs
    are not read.
    """
    found = _Join(spark, _rows(docs, id_col, text_col, F.lit(None)), words, num, den).classes()
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"))


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay when one row of each class of linked texts does, with all their columns.

    The row of the smallest id stays, null ids last, ties by a hash of the row; of
    rows that are equal in all columns one. Classes are as in ngram_jaccard_join,
    but each row counts for itself: rows that share an id are told apart by text,
    and rows without id take part. Texts without words all stay.
    """
    cols = docs.columns
    plain = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]
    rows = docs.toDF(*(f"c{i}" for i in range(len(cols))))
    where = {c: f"c{i}" for i, c in enumerate(cols)}
    rows = rows.withColumn("row", F.xxhash64(*(where[c] for c in plain)))
    # ids only name the representatives, so a row without one is named by its hash
    named = F.coalesce(F.col(where[id_col]).cast("long"), F.col("row"))
    found = _Join(spark, rows.select(named.alias("doc"), F.col(where[text_col]).cast("string").alias("text"), "row"), words, num, den)
    classes = found.ws.save(found.classes().select("doc", "row", "component"), "classes")
    found.ws.drop("features", "named")
    told = classes.where("component IS NOT NULL").groupBy("component", "row").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
    best = told.groupBy("component").agg(F.min(F.struct((F.col("doc") == F.col("row")).alias("unnamed"), "doc", "row", "copies")).alias("best"))
    kept = best.select("best.row", (F.col("best.copies") > 1).alias("again")).unionByName(classes.where("component IS NULL").select("row", F.lit(False).alias("again")).distinct())
    kept = found.ws.save(kept, "kept")
    found.ws.drop("classes")
    out = rows.join(kept.where("NOT again").select("row"), "row", "left_semi")
    if kept.where("again").limit(1).count():
        out = out.unionByName(rows.join(kept.where("again").select("row"), "row", "left_semi").dropDuplicates(["row"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))
