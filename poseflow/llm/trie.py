"""The trie of all prefixes of rebuilt conversations, from fingerprints that combine without the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import Scratch
from .streams import digests

#: The three largest primes below 2**31, and a first base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 214013, 1664525)
#: Turns of the base conversation that a rebuilt one may start with are fewer than HEADS; conversations go in groups of FAMILY.
HEADS, FAMILY = 4, 20
#: Times another base is tried where fingerprints collide.
TRIES = 4


class Monoid:
    """Fingerprints of sequences: of turn numbers t1 ... tn the sums of t_i * base**i modulo each prime.

    A sequence after another has the sum of both fingerprints, the second times base**length of the first; what stands before a part
    is taken away likewise. Longs hold all of it, in built-in functions."""

    def __init__(self, attempt: int = 0):
        self.bases = [(b + 2 * attempt * 48271) % p for b, p in zip(BASES, PRIMES)]
        self.columns = [f"g{k}" for k in range(len(PRIMES))]

    def power(self, k: int, exponent: Column) -> Column:
        """base**exponent for exponents from 0 to 2**32, a table for each byte of it."""
        out = None
        for byte in range(4):
            step = pow(self.bases[k], 256**byte, PRIMES[k])
            table = F.lit([pow(step, x, PRIMES[k]) for x in range(256)]).cast("array<long>")
            digit = F.get(table, F.shiftright(exponent.cast("long"), 8 * byte).bitwiseAND(255).cast("int"))
            out = digit if out is None else (out * digit) % PRIMES[k]
        return out

    def back(self, k: int, places: Column) -> Column:
        """base**-places for 0 to HEADS - 1 places."""
        inverse = pow(self.bases[k], -1, PRIMES[k])
        return F.get(F.lit([pow(inverse, x, PRIMES[k]) for x in range(HEADS)]).cast("array<long>"), places.cast("int"))

    def after(self, k: int, head: Column, own: Column, own_head: Column, moved: Column) -> Column:
        """The head, then what `own` has after `own_head`, which moves so many places to the front."""
        return F.pmod(head + F.pmod(own - own_head, F.lit(PRIMES[k])) * self.back(k, moved), F.lit(PRIMES[k]))


def numbered_turns(turns: DataFrame, key_col: str, monoid: Monoid) -> DataFrame:
    """key, pos (from 1), role, text, words, and the fingerprints of the turns up to this one (g) and the one before (p)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("long").alias("key"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    by = Window.partitionBy("key").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(by))
    hashed = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    number = lambda k: F.conv(F.substring(hashed, 1 + 10 * k, 10), 16, 10).cast("long") % PRIMES[k]
    rows = rows.withColumns({f"t{k}": (number(k) * monoid.power(k, F.col("pos"))) % p for k, p in enumerate(PRIMES)})
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"g{k}": F.sum(f"t{k}").over(so_far) % p for k, p in enumerate(PRIMES)})
    before = [F.pmod(F.col(f"g{k}") - F.col(f"t{k}"), F.lit(p)).alias(f"p{k}") for k, p in enumerate(PRIMES)]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    return rows.select("key", "pos", "role", "text", words, *monoid.columns, *before)


def recipes(turns: DataFrame, monoid: Monoid) -> DataFrame:
    """A row per conversation: key, base, head (turns of the base it starts with), own (turns of its own that these replace), length, h (the
    fingerprint of the head), o (that of the replaced turns) and base_first, the base's first turns."""
    first = F.when(F.col("pos") < HEADS, F.struct("pos", "words", *monoid.columns, *(f"p{k}" for k in range(len(PRIMES)))))
    convs = turns.groupBy("key").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("first"))
    convs = convs.withColumns({"wish": (F.crc32(F.col("key").cast("string").cast("binary")) % HEADS).cast("int"), "base": F.col("key") - F.col("key") % FAMILY})
    bases = convs.select(F.col("key").alias("base"), F.col("first").alias("base_first"))
    out = convs.join(bases, "base", "left").withColumn("head", F.least("wish", F.coalesce(F.size("base_first"), F.lit(0))))
    out = out.withColumn("own", F.least("wish", "n"))
    at = lambda c, n, k: F.when(F.col(n) > 0, F.get(c, F.col(n) - 1)[f"g{k}"]).otherwise(F.lit(0).cast("long"))
    prints = [f for k in range(len(PRIMES)) for f in (at("base_first", "head", k).alias(f"h{k}"), at("first", "own", k).alias(f"o{k}"))]
    return out.select("key", "base", "head", "own", (F.col("head") + F.col("n") - F.col("own")).alias("length"), "base_first", *prints)


def members(turns: DataFrame, recipe: DataFrame, monoid: Monoid) -> DataFrame:
    """Every conversation in every node it is a member of: key, depth, g and p (the node's and its parent's fingerprint), ref_key and ref_pos (the
    turn of the table that is its last), words of that turn, and ends: is this its whole sequence?"""
    long = lambda x: F.lit(x).cast("long")
    prints = [*monoid.columns, *(f"p{k}" for k in range(len(PRIMES)))]
    root = recipe.select("key", F.lit(0).alias("depth"), *(long(0).alias(c) for c in prints), long(None).alias("ref_key"), F.lit(None).cast("int").alias("ref_pos"), long(0).alias("words"), (F.col("length") == 0).alias("ends"))
    heads = recipe.where("head > 0").select("key", "base", "length", F.explode(F.slice("base_first", 1, F.col("head"))).alias("x"))
    heads = heads.select("key", F.col("x.pos").alias("depth"), *(F.col(f"x.{c}").alias(c) for c in prints), F.col("base").alias("ref_key"), F.col("x.pos").alias("ref_pos"), F.col("x.words").alias("words"), (F.col("x.pos") == F.col("length")).alias("ends"))
    tails = turns.join(recipe.drop("base", "base_first"), "key").where("pos > own")
    moved, depth = F.col("own") - F.col("head"), F.col("head") + F.col("pos") - F.col("own")
    combined = [monoid.after(k, F.col(f"h{k}"), F.col(f"{c}{k}"), F.col(f"o{k}"), moved).alias(f"{c}{k}") for c in "gp" for k in range(len(PRIMES))]
    tails = tails.select("key", depth.alias("depth"), *combined, F.col("key").alias("ref_key"), F.col("pos").alias("ref_pos"), "words", (depth == F.col("length")).alias("ends"))
    return root.unionByName(heads).unionByName(tails)


def _sound(nodes: DataFrame, variants: DataFrame, turns: DataFrame, node: list[str]) -> bool:
    """Has each node one parent, and have all its members equal last turns? Then, from the root down, all have equal sequences. Turns that
    members refer to in common are equal; others are read and compared with the one that the node's smallest member refers to."""
    if not nodes.where("first_parent <> last_parent").isEmpty():
        return False
    others = variants.join(nodes.where("variants > 1").select(*node, F.col("ref.ref_key").alias("a_key"), F.col("ref.ref_pos").alias("a_pos")), node)
    pairs = others.where("ref_key <> a_key or ref_pos <> a_pos").select("a_key", "a_pos", "ref_key", "ref_pos").distinct()
    texts = lambda x, y, name: turns.select(F.col("key").alias(x), F.col("pos").alias(y), F.struct("role", "text").alias(name))
    read = pairs.join(texts("ref_key", "ref_pos", "b"), ["ref_key", "ref_pos"], "left").join(texts("a_key", "a_pos", "a"), ["a_key", "a_pos"], "left")
    return read.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def _chain_totals(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, saved, leaves) summed over each chain and all chains that hang from it, directly or not, in as many rounds as the logarithm of
    the longest way between chains: each round adds what has gathered at twice the distance."""
    now = scratch.save(chains.select("key", "up", "saved", "leaves"), "chains0")
    k = 0
    while not now.where("up is not null").isEmpty():
        gathered = now.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        moved = now.join(above, "up", "left").join(gathered, "key", "left")
        zero = F.lit(0).cast("long")
        k += 1
        now = scratch.save(moved.select("key", F.col("next").alias("up"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves")), f"chains{k}")
    return now.select("key", F.col("saved").alias("all_saved"), F.col("leaves").alias("all_leaves"))


def prefix_trie(turns: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """A row per node of the trie: key, depth, parent_<key>, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Conversations are ordered by turn (null first), then role and text, null of these counting as empty. Each is rebuilt: it starts with the first h
    turns of the conversation key - key % 20 (all if that has fewer, none if there is none), and goes on with its own turns after its first
    h, h being crc32 of the decimal key modulo 4. A node is a distinct sequence of first turns, the root the empty one; its members are the
    rebuilt conversations that start with it. key: the smallest member, by which with the depth a node is known; n_leaves: nodes without
    children in its subtree, itself included; saved_tokens: over its subtree, words of the node's last turn times the members beyond the first;
    ends_sha256: that of the members that end there, in decimal, ascending, joined by commas.

    No rebuilt text is made. A turn is a number, a sequence a fingerprint (see `Monoid`), and that of a rebuilt prefix is made of its base's
    first turns' and its own. Prefixes are grouped by depth and fingerprint, and each group is verified by the turns it refers to; if two
    sequences collide, all is done again with other bases. The nodes with one smallest member form a chain downwards; subtree sums run over
    chains by pointer doubling and then along each chain, so rounds do not follow the depth.

    Rows without a key are left out; repeated rows are turns. A conversation that is rebuilt to no turn is a member of the root. An empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    for attempt in range(TRIES):
        monoid = Monoid(attempt)
        node = ["depth", *monoid.columns]
        own = scratch.save(numbered_turns(turns, key_col, monoid), f"turns{attempt}")
        recipe = scratch.save(recipes(own, monoid), f"recipes{attempt}")
        every = scratch.save(members(own, recipe, monoid), f"members{attempt}")
        parent = F.struct(*(f"p{k}" for k in range(len(PRIMES))))
        variants = every.groupBy(*node, "ref_key", "ref_pos").agg(
            F.min("key").alias("key"), F.count("*").alias("n"), F.min(parent).alias("first_parent"), F.max(parent).alias("last_parent"), F.min("words").alias("words"),
        )
        variants = scratch.save(variants, f"variants{attempt}")
        nodes = variants.groupBy(*node).agg(
            F.min("key").alias("key"), F.sum("n").alias("n_convs"), F.count("*").alias("variants"), F.min_by(F.struct("ref_key", "ref_pos"), "key").alias("ref"),
            F.min("first_parent").alias("first_parent"), F.max("last_parent").alias("last_parent"), F.min("words").alias("words"),
        )
        nodes = scratch.save(nodes, f"nodes{attempt}")
        if _sound(nodes, variants, own, node):
            break
    else:
        raise RuntimeError("fingerprints did not become distinct")

    zero = F.lit(0).cast("long")
    above = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(f"g{k}").alias(f"p{k}") for k in range(len(PRIMES))), F.col("key").alias("parent"))
    placed = nodes.select("key", *node, "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "first_parent.*")
    placed = placed.join(above, ["depth", *(f"p{k}" for k in range(len(PRIMES)))], "left").select("key", *node, "parent", "n_convs", "saved")
    placed = scratch.save(placed, "placed")
    children = placed.where("parent is not null").groupBy(F.col("parent").alias("key"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = placed.join(children, ["key", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    counted = scratch.save(counted.withColumn("leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")), "counted")

    up = F.max(F.when(F.col("parent") != F.col("key"), F.struct("parent", (F.col("depth") - 1).alias("at"))))
    chains = counted.groupBy("key").agg(up.alias("hook"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    chains = scratch.save(chains.select("key", F.col("hook.parent").alias("up"), F.col("hook.at").alias("at"), "saved", "leaves"), "chains")
    totals = _chain_totals(chains, scratch)
    hanging = chains.where("up is not null").join(totals, "key").groupBy(F.col("up").alias("key"), F.col("at").alias("depth")).agg(F.sum("all_saved").alias("more_saved"), F.sum("all_leaves").alias("more_leaves"))
    below = Window.partitionBy("key").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.join(hanging, ["key", "depth"], "left").withColumns({
        "saved_tokens": F.sum(F.col("saved") + F.coalesce("more_saved", zero)).over(below), "n_leaves": F.sum(F.col("leaves") + F.coalesce("more_leaves", zero)).over(below),
    })

    ends = every.where("ends").select(*node, F.col("key").alias("member")).join(nodes.select(*node, "key"), node).select("key", "depth", "member")
    hashed = digests(scratch.save(ends, "ends"), ["key", "depth"], "member", F.col("member"), ",")
    out = summed.join(hashed, ["key", "depth"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        F.col("key").alias(key_col), F.col("depth").cast("long").alias("depth"), F.col("parent").alias(f"parent_{key_col}"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", nothing).alias("ends_sha256"),
    )
