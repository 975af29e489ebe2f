"""Exact Jaccard join of shingle sets, and the classes of documents that its links connect."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.components import connected_components
from ..tables import Scratch
from .blocks import LOWER, SPACED, Hasher, text_blocks, words

#: Counters of the sketch by which shingles are ordered, and the number of parts it is summed in.
SKETCH_BITS, SKETCH_PARTS = 21, 64
#: An index list that the sketch expects to be longer is cut into lists of about this length.
LIST_ROWS = 512
#: Classes that the numbers of sets are hashed to when a later scan picks the sets it must give.
PICK_BITS = 22
#: Relative width of a block of positions in an index list.
BLOCK_STEP = 1.05
#: Of a set of n, the prefix holds n // EXTRA shingles more than one shared one would need.
EXTRA = 10


def shingle_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sets of each block's documents, as sorted arrays of distinct 64-bit hashes."""
    for some, data, offsets in text_blocks(batches, "text"):
        data = LOWER[data]
        starts, ends, marks = words(data, offsets, SPACED)
        hashes = Hasher.spans(data, starts, ends)
        runs = Hasher.runs(hashes, width)
        sets = []
        for a, b in zip(marks[:-1].tolist(), marks[1:].tolist()):
            if b - a >= width:
                own = np.sort(runs[a : b - width + 1])
                sets.append(own[np.append(True, own[1:] != own[:-1])])
            else:
                sets.append(Hasher.runs(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield some, sets


def fingerprint(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def number(print_: bytes, moved: frozenset[int]) -> int:
    """64 bits of a set's fingerprint; the numbers in `moved`, which several sets had, give way to others."""
    out = int.from_bytes(print_[:8], "little", signed=True)
    while out in moved:
        print_ = hashlib.blake2b(print_, digest_size=16).digest()
        out = int.from_bytes(print_[:8], "little", signed=True)
    return out


def summaries(docs: DataFrame, id_col: str, text_col: str, width: int, moved: frozenset[int]) -> DataFrame:
    """A row per document: id, n_shingles, set number, fingerprint; and from each task the parts of its sketch."""
    id_type = docs.schema[id_col].dataType.simpleString()
    counters, shift = 1 << SKETCH_BITS, np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int32)
        schema = None
        for some, sets in shingle_sets(batches, width):
            flat = np.concatenate(sets)
            counts += np.bincount((flat >> shift).astype(np.int64), minlength=counters).astype(np.int32)
            prints = [fingerprint(x) if len(x) else None for x in sets]
            none = pa.nulls(len(sets), pa.int32())
            out = pa.RecordBatch.from_pydict({
                "id": some.column(0), "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                "sid": pa.array([x and number(x, moved) for x in prints], pa.int64()), "print": pa.array(prints, pa.binary()),
                "part": none, "counts": pa.nulls(len(sets), pa.binary()),
            })
            schema = out.schema
            yield out
        if schema is not None:
            parts = np.split(np.minimum(counts, 65535).astype("<u2"), SKETCH_PARTS)
            nulls = [pa.nulls(SKETCH_PARTS, f.type) for f in list(schema)[:4]]
            own = [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, *own], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_shingles long, sid long, print binary, part int, counts binary")


def sketch(parts: DataFrame, partitions: int) -> np.ndarray:
    """The sums over all tasks, each rounded to an eighth of a power of two: a byte per counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_buffer(), "<u2")
                sums[part] = sums[part] + more if part in sums else more.astype(np.int64)
        levels = {k: np.minimum(np.round(8 * np.log2(1 + x)), 255).astype(np.uint8).tobytes() for k, x in sums.items()}
        yield pa.RecordBatch.from_pydict({"part": pa.array(levels, pa.int32()), "levels": pa.array(levels.values(), pa.binary())})

    rows = parts.repartition(min(SKETCH_PARTS, partitions), "part").mapInArrow(run, "part int, levels binary").toArrow()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for part, levels in zip(rows.column(0).to_pylist(), rows.column(1)):
        out[part] = np.frombuffer(levels.as_buffer(), np.uint8)
    return out.reshape(-1)


def prefixes(docs: DataFrame, text_col: str, width: int, moved: frozenset[int], levels: np.ndarray, num: int, den: int) -> DataFrame:
    """Index rows (token, salt, sid, meta) of the rarest shingles of each set; meta packs size (30 bits: a text has fewer words),
    position (29 bits, more is an error) and the logarithm of the number of parts of the list (5 bits). A token is 48 bits of the
    hash: two shingles under one token make a longer list, no wrong link.
    A further row per set, with salt -1, has the place of its last shingle in the order of all."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    mean = float(np.mean(2 ** (levels / 8.0) - 1)) if len(levels) else 0.0
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        rows = 2 ** (np.arange(256) / 8.0) - 1 - mean
        log_parts = np.ceil(np.log2(np.maximum(rows / LIST_ROWS, 1))).astype(np.int64)
        seen: set[int] = set()  # of this task: copies of a set give the same rows
        for _, sets in shingle_sets(batches, width):
            token, sid, meta, level_of, ends = [], [], [], [], []
            for own in sets:
                n = len(own)
                if not n or (of := number(fingerprint(own), moved)) in seen:
                    continue
                seen.add(of)
                keep = prefix_length(n, num, den)
                if n >> 30 or keep >> 29:
                    raise ValueError(f"a set of {n} shingles, {keep} of them to index: at most 2**30 and 2**29 have room")
                level = levels[(own >> shift).astype(np.int64)]
                order = (level.astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                first = np.argsort(order, kind="stable")[:keep]
                token.append(own[first] >> np.uint64(16)), level_of.append(level[first]), sid.append(np.full(keep, of, np.int64))
                meta.append(np.uint64(n << 34) + (np.arange(keep, dtype=np.uint64) << np.uint64(5)))
                ends.append((order[first[-1]] ^ np.uint64(1 << 63), of, n << 34))
            if token:
                sid, parts = np.concatenate(sid), log_parts[np.concatenate(level_of)]
                last, of, n = (np.array(x, t) for x, t in zip(zip(*ends), (np.uint64, np.int64, np.uint64)))
                salts = np.concatenate([sid & ((1 << parts) - 1), np.full(len(of), -1)])
                packed = np.concatenate([np.concatenate(meta) + parts.astype(np.uint64), n])
                yield pa.RecordBatch.from_pydict({
                    "token": np.concatenate([*token, last]).view(np.int64), "salt": salts.astype(np.int32),
                    "sid": np.concatenate([sid, of]), "meta": packed.view(np.int64),
                })

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token long, salt int, sid long, meta long")


def prefix_length(n: int, num: int, den: int) -> int:
    """Linked sets have at least n // EXTRA + 1 of this many first shingles of each, n being the smaller set's, in common."""
    return n - -(-num * n // den) + n // EXTRA + 1


def sets_of(docs: DataFrame, text_col: str, width: int, moved: frozenset[int], wanted: DataFrame) -> DataFrame:
    """(sid, tokens): the sets of the wanted numbers, and some others, each once."""
    picked = np.zeros(1 << PICK_BITS, bool)
    pick = F.shiftrightunsigned("sid", 64 - PICK_BITS).cast("int").alias("k")
    picked[wanted.select(pick).distinct().toArrow().column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, seen = np.unpackbits(shared.value).astype(bool), set()
        for _, sets in shingle_sets(batches, width):
            out = {}
            for own in sets:
                if len(own) and (of := number(fingerprint(own), moved)) not in seen and picked[(of % (1 << 64)) >> (64 - PICK_BITS)]:
                    seen.add(of)
                    out[of] = own.tobytes()
            yield pa.RecordBatch.from_pydict({"sid": pa.array(out, pa.int64()), "tokens": pa.array(out.values(), pa.binary())})

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sid long, tokens binary").dropDuplicates(["sid"])


#: Words of 64 bits to which the shingles of one of two compared sets alone are hashed.
MASK = 4
MASKS = [f"{side}{k}" for side in ("only_a", "only_b") for k in range(MASK)]


def overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb, inter, the exact size of the intersection, and the masks of what only a and only b have."""

    def mask(own: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * MASK, np.uint8)
        bits[(own >> np.uint64(8)) % np.uint64(64 * MASK)] = 1
        return np.packbits(bits).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                na, nb, inter, masks = [], [], [], []
                for x, y in zip(some.column("ta"), some.column("tb")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    order = np.argsort(both, kind="stable")
                    twice = both[order][1:] == both[order][:-1]
                    once = np.ones(len(both), bool)
                    once[order[1:][twice]] = False
                    once[order[:-1][twice]] = False
                    na.append(len(x)), nb.append(len(y)), inter.append(int(np.count_nonzero(twice)))
                    masks.append(np.concatenate([mask(x[once[: len(x)]]), mask(y[once[len(x) :]])]))
                masks = np.array(masks)
                counts = {k: pa.array(v, pa.int64()) for k, v in (("na", na), ("nb", nb), ("inter", inter))}
                out = {"a": some.column("a"), "b": some.column("b"), **counts}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array(masks[:, k]) for k, c in enumerate(MASKS)})

    with_b = pairs.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    both = with_b.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long, na long, nb long, inter long, " + ", ".join(f"{c} long" for c in MASKS))


class Rule:
    """Links at intersection / union >= num / den, as integer arithmetic on sizes and positions."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, x: str, y: str) -> str:
        """The least intersection of linked sets of these sizes."""
        return f"(({self.num} * ({x} + {y}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def sizes(self, x: str, y: str) -> str:
        return f"(least({x}, {y}) * {self.den} >= greatest({x}, {y}) * {self.num})"

    def positions(self, x: str, px: str, y: str, py: str) -> str:
        """Can sets with a shared token at these positions reach the intersection with what they share before and after it?"""
        return f"(least({px}, {py}) + least({x} - {px}, {y} - {py}) >= {self.needed(x, y)})"

    def prefix(self, x: str) -> str:
        return f"({x} - (({self.num} * {x} + {self.den - 1}) div {self.den}) + {x} div {EXTRA} + 1)"

    def common(self, x: str) -> str:
        """The least number of prefix tokens that a set has in common with a linked one, which may be smaller."""
        return f"((({self.num} * {x} + {self.den - 1}) div {self.den}) div {EXTRA} + 1)"

    def ranks(self, x: str, rx: str, y: str, ry: str) -> str:
        """Is a token among the rarest of both prefixes that one of the pair's common tokens must be among? Of x's prefix at most x - needed tokens
        are not in y, so the prefixes have so many in common that the rarest one is not further back."""
        common = f"least({self.prefix(x)} - {x}, {self.prefix(y)} - {y}) + {self.needed(x, y)}"
        return f"({rx} <= {self.prefix(x)} - ({common}) + 1 and {ry} <= {self.prefix(y)} - ({common}) + 1)"

    def alone(self, x: str, ax: str, ex: str, y: str, ay: str, ey: str) -> str:
        """Can sets reach the intersection, given how many tokens of each prefix no other prefix has, and where the prefixes end in the order of all?
        The prefix that ends first has nothing there that the other set could hold beyond its own prefix."""
        return f"(case when {ex} <= {ey} then {x} - {ax} else {y} - {ay} end >= {self.needed(x, y)})"

    def alone_at_most(self, x: str, ax: str, y: str, ay: str) -> str:
        """What `alone` allows where it is not known which prefix ends first."""
        return f"(greatest({x} - {ax}, {y} - {ay}) >= {self.needed(x, y)})"

    def linked(self, inter: str, x: str, y: str) -> str:
        return f"({inter} * {self.den} >= ({x} + {y} - {inter}) * {self.num})"


def block(places: Column) -> Column:
    return F.floor(F.log(places) / float(np.log(BLOCK_STEP))).cast("int")


#: What `Join.anchors` keeps of a set's pivot.
KEPT = ["pivot", "inter", "psize", *[f"{n}{k}" for n in ("own", "lacks") for k in range(MASK)]]


class Join:
    """One run over a table of documents, by the five steps of `similar_classes`; a method per step."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.width, self.num, self.den = width, num, den
        self.rule = Rule(num, den)
        self.scratch = Scratch(docs.sparkSession, "similarity")
        self.moved: frozenset[int] = frozenset()

    def number_sets(self) -> tuple[DataFrame, DataFrame, np.ndarray]:
        """Step 1. Rows (id, n_shingles, sid), classes of equal sets (sid, rep: the smallest id), and the levels of the sketch."""
        for k in range(8):
            table = summaries(self.docs, self.id_col, self.text_col, self.width, self.moved)
            table = self.scratch.save(table, f"summaries{k}")
            rows = table.where("part is null")
            prints = [F.min("print").alias("p"), F.max("print").alias("q")]
            grouped = rows.where("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), *prints)
            classes = self.scratch.save(grouped, f"classes{k}")
            # Different sets of one number: about n**2 / 2**65 of n sets.
            shared = {x[0] for x in classes.where("p <> q").select("sid").collect()}
            if not shared:
                break
            self.moved |= shared
        else:
            raise RuntimeError("the numbers of sets did not become distinct")
        partitions = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        levels = sketch(table.where("part is not null").select("part", "counts"), partitions)
        return rows.select("id", "n_shingles", "sid"), classes.select("sid", "rep"), levels

    def index_lists(self, levels: np.ndarray) -> DataFrame:
        """Step 2. (token, sid, size, pos, end, psid, psize, ppos, alone, rank, rarest): the rows of lists with at least two sets, of
        the sets with enough of them. end: where the set's prefix ends in the order of all; psid, psize, ppos: the list's set with the
        fewest shingles of its own; alone: prefix shingles that no other prefix has; rank: the row's place among the set's, shortest
        list first; rarest: is it among those that suffice?"""
        rule, scratch = self.rule, self.scratch
        by = Window.partitionBy("token", "salt").orderBy("sid")
        every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        indexed = prefixes(self.docs, self.text_col, self.width, self.moved, levels, self.num, self.den)
        indexed = indexed.withColumns({
            "least": F.first("sid").over(every), "most": F.last("sid").over(every), "before": F.lag("sid").over(by),
        })
        # A list that is cut may have its other sets in another part.
        shared = indexed.where("(least <> most or meta & 31 > 0 or salt = -1) and (before is null or before <> sid)")
        size, pos = F.expr("shiftrightunsigned(meta, 34) size"), F.expr("shiftrightunsigned(meta, 5) & 536870911 pos")
        shared = scratch.save(shared.select("token", "salt", "sid", size, pos), "shared")

        own = Window.partitionBy("sid")
        enough_of = lambda df: df.where(F.col("n") >= F.expr(rule.common("size")))
        alone = F.expr(f"{rule.prefix('size')} - n")
        end = F.max(F.when(F.col("salt") < 0, F.col("token"))).over(own)
        counted = shared.withColumns({"n": F.count_if(F.col("salt") >= 0).over(own), "end": end})
        enough = enough_of(counted).where("salt >= 0").withColumn("alone", alone).drop("n", "salt")
        enough = scratch.save(enough, "enough")
        scratch.drop("shared")

        pivot = F.min(F.struct("alone", "size", "sid", "pos")).alias("p")
        heads = enough.groupBy("token").agg(F.count("*").alias("df"), pivot).where("df > 1")
        named = [F.col(f"p.{c}").alias(f"p{c}") for c in ("sid", "size", "pos")]
        heads = scratch.save(heads.select("token", "df", *named), "heads")
        lists = enough_of(enough.join(heads, "token").withColumn("n", F.count("*").over(own))).withColumn("alone", alone)
        lists = lists.withColumn("rank", F.col("alone") + F.row_number().over(own.orderBy("df", "token")))
        rarest = F.expr(f"rank <= {rule.prefix('size')} - {rule.common('size')} + 1")
        lists = scratch.save(lists.withColumn("rarest", rarest).drop("n", "df"), "lists")
        scratch.drop("enough", "heads")
        return lists

    def compare_pivots(self, lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Step 3. The pairs (a, b) compared, what `overlap` found of them, and the sets (sid, tokens) of the lists."""
        rule, scratch = self.rule, self.scratch
        met = lists.where("sid <> psid").where(rule.sizes("size", "psize")).where(rule.positions("size", "pos", "psize", "ppos"))
        met = met.groupBy("sid", "psid").agg(F.count("*").alias("n"))
        pivots = scratch.save(met.groupBy("sid").agg(F.max_by("psid", F.struct("n", "psid")).alias("psid")), "pivots")
        nexts = pivots.select(F.col("sid").alias("psid"), F.col("psid").alias("next"))
        further = pivots.join(nexts, "psid").select("sid", F.col("next").alias("psid"))
        pairs = pivots.union(further).where("sid <> psid")
        pairs = pairs.select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")).distinct()
        pairs = scratch.save(pairs, "pairs")
        wanted = lists.where("rarest").select("sid")
        sets = scratch.save(sets_of(self.docs, self.text_col, self.width, self.moved, wanted), "sets")
        return pairs, scratch.save(overlap(pairs, sets), "known"), sets

    def anchors(self, known: DataFrame) -> DataFrame:
        """(sid, pivot, inter, psize, own0 ..., lacks0 ...): of the sets that a set was compared with, that which most were; their
        intersection, its size, and the masks of what only the set and only the pivot have."""

        def side(own: str, other: str) -> DataFrame:
            masks = [F.col(f"only_{x}{k}").alias(f"{n}{k}") for n, x in (("own", own), ("lacks", other)) for k in range(MASK)]
            return known.select(F.col(own).alias("sid"), F.col(other).alias("pivot"), "inter", F.col(f"n{other}").alias("psize"), *masks)

        answers = self.scratch.save(side("a", "b").union(side("b", "a")), "answers")
        popular = self.scratch.save(answers.groupBy("pivot").agg(F.count("*").alias("met")), "popular")
        best = F.max_by(F.struct(*KEPT), F.struct("met", "inter", "pivot")).alias("k")
        return self.scratch.save(answers.join(popular, "pivot").groupBy("sid").agg(best).select("sid", "k.*"), "anchors")

    def open_pairs(self, lists: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
        """Step 4. (a, b, derived): pairs that share a list, are not connected yet and may be linked; derived: surely linked, as
        the answers of their common pivot show."""
        rule, scratch, num, den = self.rule, self.scratch, self.num, self.den
        placed = lists.where("rarest").select("token", "sid", "size", "pos", "rank", "alone", "end")
        placed = placed.join(roots.withColumnRenamed("node", "sid"), "sid", "left").join(self.anchors(known), "sid", "left")
        placed = scratch.save(placed.withColumn("root", F.coalesce("root", "sid")), "placed")
        # Of each list with several components, the largest need not meet itself.
        counted = placed.groupBy("token", "root").agg(F.count("*").alias("n"))
        largest = F.max_by("root", F.struct("n", "root")).alias("main")
        main = counted.groupBy("token").agg(largest, F.count("*").alias("roots")).where("roots > 1").drop("roots")
        open_ = placed.join(scratch.save(main, "main"), "token").withColumn("minor", F.col("root") != F.col("main")).drop("main")
        open_ = scratch.save(open_.withColumn("block", block(F.col("size") - F.col("pos"))), "open")

        # By its position, a set can only reach the intersection with partners that have so many shingles from theirs on.
        low = F.expr(f"greatest(({num} * size + {den - 1}) div {den} - pos, 1)")
        high = F.expr(f"greatest(size - pos + size * {den} div {num} - size, 1)")
        reach = F.explode(F.sequence(block(low) - 1, block(high) + 1))
        # Many sets of a list may agree in all that the tests read (texts made from a template do): such sets are one kind, and
        # kinds meet before sets do. A list has few kinds, whatever its length.
        kind = ["size", "pos", "rank", "alone"]
        kinds = scratch.save(open_.groupBy("token", "block", *kind).agg(F.count("*").alias("n"), F.bool_or("minor").alias("minor")), "kinds")
        of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in (*kind, "n")]
        kind_left = kinds.where("minor").select("token", reach.alias("block"), F.col("block").alias("own_block"), *of("x"))
        kind_met = kind_left.join(kinds.select("token", "block", *of("y")), ["token", "block"])
        kind_met = kind_met.where(rule.sizes("size_x", "size_y")).where(rule.positions("size_x", "pos_x", "size_y", "pos_y"))
        kind_met = kind_met.where(rule.ranks("size_x", "rank_x", "size_y", "rank_y"))
        # A set is alone in its own kind.
        own_kind = " and ".join(f"{c}_x = {c}_y" for c in kind)
        kind_met = kind_met.where(rule.alone_at_most("size_x", "alone_x", "size_y", "alone_y")).where(f"n_x > 1 or not (own_block = block and {own_kind})")
        kind_met = scratch.save(kind_met.select("token", "own_block", "block", *[f"{c}_{x}" for x in "xy" for c in kind]), "kinds-met")

        sided = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("sid", *kind, "end", "root", *KEPT)]
        left = open_.where("minor").select("token", F.col("block").alias("own_block"), *sided("x"))
        left = left.join(kind_met, ["token", "own_block", *[f"{c}_x" for c in kind]]).drop("own_block")
        right = open_.select("token", "block", "minor", *sided("y"))
        met = left.join(right, ["token", "block", *[f"{c}_y" for c in kind]]).where("root_x <> root_y and (not minor or sid_x < sid_y)")
        met = met.where(rule.alone("size_x", "alone_x", "end_x", "size_y", "alone_y", "end_y"))

        # |x & y| from |x & p| and |y & p|: inside p at most what neither lacks, outside at most what isn't seen to be one's own;
        # at least what p has no room for.
        needed = rule.needed("size_x", "size_y")
        same = "coalesce(pivot_x = pivot_y, false)"
        bits = lambda f: "(" + " + ".join(f"bit_count({f.format(k=k)})" for k in range(MASK)) + ")"
        inside = f"least(inter_x, inter_y, psize_x - {bits('lacks{k}_x | lacks{k}_y')})"
        outside_x = f"size_x - inter_x - {bits('own{k}_x & ~own{k}_y')}"
        outside_y = f"size_y - inter_y - {bits('own{k}_y & ~own{k}_x')}"
        met = met.where(f"not {same} or {inside} + least({outside_x}, {outside_y}) >= {needed}")
        derived = F.expr(f"{same} and inter_x + inter_y - psize_x >= {needed}").alias("derived")
        pairs = met.select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b"), derived)
        return pairs.groupBy("a", "b").agg(F.bool_or("derived").alias("derived"))

    def run(self) -> DataFrame:
        scratch = self.scratch
        rows, classes, levels = self.number_sets()
        lists = self.index_lists(levels)
        pairs, known, sets = self.compare_pivots(lists)
        linked = known.where(self.rule.linked("inter", "na", "nb")).select("a", "b")
        roots = scratch.save(connected_components(linked), "roots")
        rest = scratch.save(self.open_pairs(lists, known, roots).join(pairs, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            more = scratch.save(overlap(rest.where("not derived"), sets), "more").where(self.rule.linked("inter", "na", "nb"))
            links = linked.union(more.select("a", "b")).union(rest.where("derived").select("a", "b"))
            roots = scratch.save(connected_components(links), "roots2")

        # Step 5. The smallest id of each component, and of each set.
        placed = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        placed = scratch.save(placed, "classes-placed")
        least = scratch.save(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
        found = scratch.save(placed.join(least, "root").select("sid", "component_id"), "found")
        scratch.drop("lists", "sets", "open", "placed", "known", "pairs", "rest", "more", "pivots", "answers", "popular", "anchors")
        scratch.drop("main", "roots", "roots2", "classes-placed", "least", "kinds", "kinds-met")
        out = rows.join(found, "sid", "left")
        return out.select(F.col("id").alias(self.id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The id, n_shingles and component_id of every row of docs.

    A text's words are runs of other characters than blanks and \\x09-\\x0D, A-Z counting as a-z; its set is that of
    its shingles of `width` words, or the whole sequence of fewer. Two rows are linked if 100 * intersection >= 80 *
    union (num, den); component_id is the smallest id that links lead to. A null text, or one without words, has an
    empty set and no links. Equal sets are linked; repeated rows and repeated ids are rows like others; a null id
    is never the smallest unless there is no other. An empty table gives no rows. Other columns are not read.

    Shingles are 64-bit hashes; sets have 128-bit fingerprints and, within a run, 64-bit numbers that are checked to
    be distinct. Steps, each a scan or a join over all rows (see `Join`):

    1. Equal sets become one. A sketch counts all shingles, and orders them by rarity.
    2. The first |s| - ceil(0.8 |s|) + |s| div 10 + 1 shingles of each set go to index lists; a list expected to be long is cut by set
       number. Linked sets share at least ceil(0.8 |s|) div 10 + 1 of these, so a set with fewer in lists of two or
       more is linked with none and leaves. Of those that stay, the shingles of the shortest lists suffice, the fewer the more two sizes
       demand in common.
    3. Each set is compared with one other, its pivot, and with the pivot's pivot: of each of its lists the set with the fewest shingles
       of its own, which for copies is what they were copied from, and of these the one met most often.
    4. What is left are pairs that share a list and that the links so far don't connect. Lists are cut into blocks by how many shingles
       follow the position; a partner's position lies within bounds, so a set skips all other blocks. A set's prefix shingles that no
       other prefix has count against it. Of two sets with the same pivot, their intersections with it, computed in step 3, bound
       their own from both sides, which answers many pairs without reading them. The others are compared exactly. Sets of a list with equal sizes,
       positions and ranks are one kind; kinds meet first, and sets of two kinds only where these may be linked.
    5. Connected components over the links.

    Sets of large groups of near copies are thus compared with a pivot, not with each other, and no pair is skipped
    that could connect two components.
    """
    return Join(docs, id_col, text_col, width, num, den).run()
