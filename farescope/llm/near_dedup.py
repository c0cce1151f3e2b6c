"""Near duplicates by an inverted join over MinHash signature coordinates.

1. Every text gives its set of word shingles, a digest of the set and a signature of COORDINATES minima. Rows with equal
   sets form a class with a number of its own; only classes go on.
2. A class is posted under the coordinate-value pairs of its prefix, each a 64-bit name: two signatures that agree in at least m
   coordinates share a pair among any COORDINATES - m + 1 of either one, in whatever fixed order. Lists with one
   class, and lists with the same members as another list, go.
3. Within a list, collisions are counted coordinate slab by slab. A pair whose remaining coordinates cannot reach
   m is skipped, and so is a pair that is already connected. What comes out is a spanning forest of the pairs
   above the match threshold, never all pairs.
4. The forest's components are candidate groups. The whole texts of a group meet, and every link that could join two parts
   of the group is tested on the full shingle sets.

Long lists and large groups are cut into blocks, each a task's work, and every block gets a copy of the leader, the smallest
class of the list or group. Members that their block connects with the leader are connected with each other; a link that is
missing has an end among the others, so only these are copied to the other blocks, in a second pass. Copies of one text thus cost
rows in proportion to their number.

The number m follows from the threshold: a pair at the threshold agrees in fewer coordinates with a chance of 5e-6 at most
(40 of 64 at 85 of 100); pairs above it are missed far less often. Work grows with the square only of distinct texts that
are alike in most shingles but not linked with a leader.

Rules for odd input: a null text is the empty text. A text without words is linked with nothing. Every row is a document: rows that
repeat an id and its text get the same answer, other texts under one id are linked each by its own set. A row with a null
doc_id adds no links; it has the component of the rows with its set, if there are any. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import WordHashes, by_key, components, free_name, grouped, join_groups, maybe_in, mixed, saved, shingles, text_bytes, word_hashes

WIDTH = 5
COORDINATES = 64
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Largest chance that a pair at the threshold is no candidate.
MISSED = 5e-6
#: Classes in one block of a posting list.
LIST_BLOCK = 1024
#: Lists up to this length are compared by shifted rows, all lists of a batch at once.
SHORT = 24
#: Shingles in one block of a candidate group.
GROUP_BLOCK = 400_000
#: Coordinates counted before hopeless pairs are skipped.
SLAB = 16

_SEEDS = np.random.default_rng(20_240_501).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64)
_PLACES = np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
_FACTORS, _SHIFTS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def minima(found: np.ndarray) -> np.ndarray:
    """Minima of COORDINATES random linear functions over a non-empty set."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(out, (found[at : at + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=out)
    return out


def matches(percent: int) -> int:
    """Agreeing coordinates that make a candidate: as many as a pair at the threshold falls short of with chance MISSED at most."""
    s, below = percent / 100, 0.0
    for m in range(COORDINATES):
        below += math.comb(COORDINATES, m) * s**m * (1 - s) ** (COORDINATES - m)
        if below > MISSED:
            return max(m, 1)
    return COORDINATES


def prefix(least: np.ndarray, least_matches: int) -> np.ndarray:
    """The coordinate-value pairs under which a signature is posted: the first ones in the order of their 64-bit names."""
    return np.sort(mixed(least + _PLACES))[: COORDINATES - least_matches + 1]


def _sets(least_matches: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sizes, keys, signs, posts = [], [], [], []
            for text in text_bytes(batch.column("text")):
                found = shingles(word_hashes(text, cache), WIDTH)
                sizes.append(len(found))
                least = minima(found) if len(found) else None
                keys.append(None if least is None else hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                # The low bits of a minimum are as good as random, and tell values apart.
                signs.append(None if least is None else (least & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                posts.append(None if least is None else prefix(least, least_matches).tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()),
                "sign": pa.array(signs, pa.binary()), "posts": pa.array(posts, pa.binary()), "text_key": batch.column("text_key")})

    return work


def sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (null without words), sign (16 bits of each coordinate), posts (names of pairs), text_key."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key().alias("text_key")).mapInArrow(
        _sets(matches(percent)), "doc_id long, n_shingles long, set_key binary, sign binary, posts binary, text_key long")


def text_key(text: str = "text") -> Column:
    """A hash of a text; a null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            names = np.frombuffer(b"".join(batch.column("posts").to_pylist()), np.int64)
            yield pa.RecordBatch.from_pydict({"pair": names, "node": np.repeat(batch.column("node").to_numpy(), len(names) // batch.num_rows)})


class Forest:
    """Union-find over positions 0 to n-1."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.parts = n

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root[a], self.root[b]
        if ra == rb:
            return False
        low, high = (ra, rb) if ra < rb else (rb, ra)
        self.root[self.root == high] = low
        self.parts -= 1
        return True


def _agreeing(row: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
    """Positions of the signatures that agree with a row in `least` coordinates or more."""
    alive = np.arange(len(others))
    count = np.zeros(len(others), np.int64)
    for at in range(0, COORDINATES, SLAB):
        count = count + (others[alive, at : at + SLAB] == row[at : at + SLAB]).sum(axis=1)
        good = count + (COORDINATES - SLAB - at) >= least
        alive, count = alive[good], count[good]
        if not len(alive):
            break
    return alive


def _long_list(signs: np.ndarray, least: int) -> tuple[list[tuple[int, int]], Forest]:
    """Links (later, earlier) of a spanning forest within a list, by position."""
    forest, out = Forest(len(signs)), []
    for i in range(len(signs) - 1):
        if forest.parts == 1:
            break
        rest = i + 1 + np.flatnonzero(forest.root[i + 1 :] != forest.root[i])
        for j in rest[_agreeing(signs[i], signs[rest], least)]:
            if forest.join(i, int(j)):
                out.append((int(j), i))
    return out, forest


def _links(pairs: list[tuple[int, int]], rest: list[tuple[int, int]] = []) -> pa.RecordBatch:
    """Links (a, b), and members (a) of a group (key) that their block does not connect with its leader."""
    rows = [(a, b, None) for a, b in pairs] + [(a, None, key) for key, a in rest]
    a, b, key = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "key": pa.array(key, pa.int64())})


LINKS = "a long, b long, key long"


def _collide(least: int, short: int):
    """Links above the match threshold within each block of a list; rows are sorted by list, block and class."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        rows = 0
        for table in grouped(batches, ["pair", "block"]):
            waiting.append(table)
            rows += table.num_rows
            if rows >= 4096:
                yield _links(*collided(waiting))
                waiting, rows = [], 0
        if waiting:
            yield _links(*collided(waiting))

    def collided(lists: list[pa.Table]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        out: set[tuple[int, int]] = set()
        rest = []
        whole = [t for t in lists if t.num_rows <= short and t.column("blocks")[0].as_py() == 1]
        for table in lists:
            if table.num_rows > short or table.column("blocks")[0].as_py() > 1:
                nodes = table.column("node").to_numpy()
                found, forest = _long_list(_matrix(table), least)
                out.update((int(nodes[j]), int(nodes[i])) for j, i in found)
                if table.column("blocks")[0].as_py() > 1:
                    # The leader has the smallest number, so it is the first.
                    pair = table.column("pair")[0].as_py()
                    rest += [(pair, int(x)) for x in nodes[forest.root != forest.root[0]]]
        if whole:
            table = pa.concat_tables(whole)
            of = np.repeat(np.arange(len(whole)), [t.num_rows for t in whole])
            nodes, signs = table.column("node").to_numpy(), _matrix(table)
            for shift in range(1, max(t.num_rows for t in whole)):
                at = np.flatnonzero(of[shift:] == of[:-shift])
                for slab in range(0, len(at), 65_536):
                    part = at[slab : slab + 65_536]
                    good = part[(signs[part] == signs[part + shift]).sum(axis=1) >= least]
                    out.update(zip(nodes[good + shift].tolist(), nodes[good].tolist()))
        return list(out), rest

    return work


def _led(own: np.ndarray, rest: np.ndarray) -> Forest:
    """The parts of a block before the second pass: its own members that do not lie open are connected through the leader."""
    forest = Forest(len(own))
    led = np.flatnonzero(own & ~rest)
    if len(led):
        forest.root[led] = led[0]
        forest.parts -= len(led) - 1
    return forest


def _collide_rest(least: int):
    """Links between the members of a list that are not connected with its leader, and the members of another block.

    What comes out of a block is a spanning forest, so its rows are no more than the members that lie open there.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["pair", "block"]):
            own = table.column("own").to_numpy(zero_copy_only=False)
            nodes, signs, rest = table.column("node").to_numpy(), _matrix(table), table.column("rest").to_numpy(zero_copy_only=False)
            here = np.flatnonzero(own)
            forest, out = _led(own, rest), []
            for i in np.flatnonzero(~own):
                # Of two that both lie open, the one with the smaller number goes to the other's block.
                there = here[(~rest[here] | (nodes[here] > nodes[i])) & (forest.root[here] != forest.root[i])]
                out += [(int(nodes[j]), int(nodes[i])) for j in there[_agreeing(signs[i], signs[there], least)] if forest.join(int(i), int(j))]
            if out:
                yield _links(out)

    return work


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint16).reshape(-1, COORDINATES)


def block_pairs(rows: DataFrame, blocks: str, by: str) -> DataFrame:
    """Copy each row to the pairs of blocks (left <= right) that hold its block; one block makes the pair (0, 0)."""
    own = F.pmod(F.xxhash64(by), F.col(blocks))
    return rows.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))).select(
        *[c for c in rows.columns if c != blocks], F.least("__own", "__other").alias("left"), F.greatest("__own", "__other").alias("right"))


def in_blocks(rows: DataFrame, leader: str, by: str = "node") -> DataFrame:
    """Rows of groups with their block; the leader of a group (`leader` names its column) goes to every block of it."""
    own = F.pmod(F.xxhash64(by), F.col("blocks"))
    every = F.when((F.col("blocks") > 1) & (F.col(by) == F.col(leader)), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.withColumn("block", F.explode(every))


def open_blocks(rows: DataFrame, by: str = "node") -> DataFrame:
    """Rows of groups with their own block, and those that lie open (`rest`) once more for each other block, with `own` false."""
    own = F.pmod(F.xxhash64(by), F.col("blocks"))
    every = F.when(F.col("rest"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.withColumn("block", F.explode(every)).withColumn("own", F.col("block") == F.pmod(F.xxhash64(by), F.col("blocks")))


def second_pass(first: DataFrame, keys: str) -> DataFrame | None:
    """What lies open after the first pass, as (key, node, rest); None if nothing does."""
    rest = first.where("key IS NOT NULL").select(F.col("key").alias(keys), F.col("a").alias("node"), F.lit(True).alias("rest")).distinct()
    return None if rest.isEmpty() else rest


def candidates(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all classes whose signatures are above the match threshold; `classes` has node, sign and posts."""
    least = matches(percent)
    posts = saved(classes.select("node", "posts").mapInArrow(_post, "pair long, node long"), "postings")
    lists = posts.groupBy("pair").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"),
                                      F.min("node").alias("leader"))
    lists = lists.where("n > 1").groupBy("n", "x", "y").agg(F.min("pair").alias("pair"), F.min("leader").alias("leader")).select(
        "pair", "leader", F.ceil(F.col("n") / LIST_BLOCK).cast("bigint").alias("blocks"))
    signs = classes.select("node", "sign")
    members = in_blocks(posts.join(lists, "pair"), "leader").drop("leader").join(signs, "node")
    first = saved(by_key(members, ["pair", "block"], ["node"]).mapInArrow(_collide(least, SHORT), LINKS).distinct(), "collisions")
    found = first.where("b IS NOT NULL").select("a", "b")
    rest = second_pass(first, "pair")
    if rest is None:
        return found
    left = posts.join(lists.drop("leader").join(rest.select("pair").distinct(), "pair"), "pair").join(rest, ["pair", "node"], "left").withColumn(
        "rest", F.coalesce("rest", F.lit(False)))
    met = by_key(open_blocks(left).join(signs, "node"), ["pair", "block"], ["node"])
    return found.unionByName(met.mapInArrow(_collide_rest(least), LINKS).select("a", "b").distinct())


def _linked(found: list[np.ndarray], percent: int, forest: Forest) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among full shingle sets.

    Intersections of one set with all others are counted over an index of the shingles; sets that are already
    connected with it are skipped.
    """
    sizes = np.array([len(x) for x in found])
    if len(found) <= 8:
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                small, large = sorted((sizes[i], sizes[j]))
                if forest.root[i] != forest.root[j] and 100 * small >= percent * large:
                    both = len(np.intersect1d(found[i], found[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both) and forest.join(i, j):
                        yield i, j
        return
    counts = Overlaps(found)
    for i in range(len(found)):
        if forest.parts == 1:
            return
        both = counts.of(found[i])
        good = (100 * both >= percent * (sizes + sizes[i] - both)) & (forest.root != forest.root[i])
        for j in np.flatnonzero(good):
            if forest.join(i, int(j)):
                yield i, int(j)


class Overlaps:
    """Sizes of the intersections of a set with each of many, by an index of their shingles."""

    def __init__(self, found: list[np.ndarray]):
        self.n = len(found)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in found])
        self.known, code = np.unique(np.concatenate(found), return_inverse=True)
        self.held = owner[np.argsort(code, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(code))))

    def of(self, one: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, one)
        codes = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == one)]
        begin, length = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        # Owners of all shingles of the set, one after another.
        places = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum()) if len(codes) else codes
        return np.bincount(self.held[places], minlength=self.n)


def unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root, block and node without repeats: a row that repeats in the table counts once."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "block", "node")], axis=1)
        new = np.concatenate(([last is None or (names[0] != last).any()], (names[1:] != names[:-1]).any(axis=1)))
        last = names[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def _confirm(percent: int):
    """Links on full sets within each block of a group; rows are sorted by group, block and class."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        out: list[tuple[int, int]] = []
        rest: list[tuple[int, int]] = []
        for table in grouped(unrepeated(batches), ["root", "block"]):
            nodes = table.column("node").to_numpy()
            found = [shingles(word_hashes(text, cache), WIDTH) for text in text_bytes(table.column("text"))]
            forest = Forest(len(found))
            out += [(int(nodes[i]), int(nodes[j])) for i, j in _linked(found, percent, forest)]
            if table.column("blocks")[0].as_py() > 1:
                # The root has the smallest number, so it is the first.
                rest += [(int(nodes[0]), int(x)) for x in nodes[forest.root != forest.root[0]]]
            if len(out) + len(rest) > 10_000:
                yield _links(out, rest)
                out, rest = [], []
        yield _links(out, rest)

    return work


def _confirm_rest(percent: int):
    """Links on full sets between members of a group that are not connected with its leader, and the members of another block;
    a spanning forest of them for each block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for table in grouped(unrepeated(batches), ["root", "block"]):
            own = table.column("own").to_numpy(zero_copy_only=False)
            nodes, rest = table.column("node").to_numpy(), table.column("rest").to_numpy(zero_copy_only=False)
            found = [shingles(word_hashes(text, cache), WIDTH) for text in text_bytes(table.column("text"))]
            here = np.flatnonzero(own)
            if not len(here):
                continue
            sizes, counts = np.array([len(found[j]) for j in here]), Overlaps([found[j] for j in here])
            forest, out = _led(own, rest), []
            for i in np.flatnonzero(~own):
                both = counts.of(found[i])
                good = (100 * both >= percent * (sizes + len(found[i]) - both)) & (~rest[here] | (nodes[here] > nodes[i]))
                out += [(int(nodes[j]), int(nodes[i])) for j in here[good] if forest.join(int(i), int(j))]
            yield _links(out)

    return work


def _rows(docs: DataFrame, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, text_key, component."""
    rows = saved(sets(docs, percent), "sets")
    total = rows.count()
    # One text of a class is enough: that of its smallest id and, of those, the smallest hash.
    one = F.min(F.struct("doc_id", "text_key"))
    classes = saved(rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        one.alias("one"), F.first("sign").alias("sign"), F.first("posts").alias("posts"), F.first("n_shingles").alias("n_shingles"),
        F.count("*").alias("members")).select(F.monotonically_increasing_id().alias("node"), "set_key", "one.doc_id", "one.text_key", "sign", "posts",
                                              "n_shingles", "members"), "classes")
    guesses = components(candidates(classes, percent), "candidates")
    load = classes.select("node", "doc_id", "text_key", "n_shingles").join(guesses.withColumnRenamed("id", "node"), "node")
    blocks = load.groupBy("root").agg(F.ceil(F.sum("n_shingles") / GROUP_BLOCK).cast("bigint").alias("blocks"))
    # Only texts with candidates move.
    wanted = load.select(F.col("doc_id").alias("__rep"), F.col("text_key").alias("__key"), "node", "root").join(blocks, "root")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("__rep"), text_key().alias("__key"), "text")
    texts = maybe_in(plain, wanted, ["__rep", "__key"]).join(wanted, ["__rep", "__key"]).drop("__rep", "__key")
    met = by_key(in_blocks(texts, "root"), ["root", "block"], ["node"])
    first = saved(met.mapInArrow(_confirm(percent), LINKS), "confirmed")
    found = first.where("b IS NOT NULL").select("a", "b")
    rest = second_pass(first, "root")
    if rest is not None:
        left = texts.join(rest.select("root").distinct(), "root").join(rest, ["root", "node"], "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
        again = by_key(open_blocks(left), ["root", "block"], ["node"])
        found = found.unionByName(again.mapInArrow(_confirm_rest(percent), LINKS).select("a", "b"))
    links = components(found, "links")
    named = classes.join(links.withColumnRenamed("id", "node"), "node", "left").select("set_key", "members", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    roots = named.join(least, "root").select("set_key", "members", "component")
    return join_groups(rows.drop("sign", "posts"), roots, ["set_key"], "members", total).select(
        "doc_id", "n_shingles", "text_key", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    component = F.col("component")
    return _rows(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of a table that stay, with all their columns: one document of each component. A text goes if it is a near copy
    of one with a smaller id; other texts under its id stay."""
    doc_id, key = free_name(docs, "gone_id"), free_name(docs, "gone_key")
    gone = _rows(docs, percent).where("component <> doc_id").select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("bigint") == gone[doc_id]) & (text_key() == gone[key]), "left_anti")
