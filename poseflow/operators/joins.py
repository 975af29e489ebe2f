"""Equi joins between tables of structures, pairs and keys."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.vectors import hash_uniform
from .ranks import place


def criteria_join(lists: list[DataFrame]) -> DataFrame | None:
    """Keep-lists with the same columns are united without repeats; the results are joined on the columns they share."""
    groups: dict[tuple[str, ...], DataFrame] = {}
    for df in lists:
        header = tuple(sorted(df.columns))
        groups[header] = groups[header].unionByName(df) if header in groups else df
    tables = [df.distinct() for df in groups.values()]

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        return a.join(b, shared) if shared else a.crossJoin(b)

    return functools.reduce(join, tables) if tables else None


def prune_pairs(pairs: DataFrame, pair_chains: DataFrame, criteria: DataFrame | None, always: DataFrame | None = None) -> DataFrame:
    """Pairs (code, struct_id, pair_id) that a keep-list holds (C4).

    A pair stays without criteria, if its code is always kept, or if a listed row equals it in code, struct_id ('1' where the list has none) and
    pair_id, as far as the list has these, and every chain of the pair (pair_chains: code, pair_id, chain) is listed where the list has chains.
    """
    if criteria is None:
        return pairs
    listed = criteria if "struct_id" in criteria.columns else criteria.withColumn("struct_id", F.lit("1"))
    on = [c for c in ("code", "struct_id", "pair_id") if c in listed.columns]
    kept = pairs.join(listed.select(*on).distinct(), on, "left_semi")
    if "chain" in listed.columns:
        known = listed.select(*[c for c in ("code", "pair_id", "chain") if c in listed.columns]).distinct()
        missing = pair_chains.join(known, [c for c in ("code", "pair_id", "chain") if c in known.columns], "left_anti")
        kept = kept.join(missing.select("code", "pair_id").distinct(), ["code", "pair_id"], "left_anti")
    if always is not None:
        kept = kept.unionByName(pairs.join(always.select("code").distinct(), "code", "left_semi").select(*kept.columns)).distinct()
    return kept.select(*pairs.columns)


def attach_features(atoms: DataFrame, features: DataFrame, keys: list[str], defaults: dict, only_ca: bool = True) -> DataFrame:
    """atoms with the features of their residue, a default where there are none, and null on other atoms than CA (C5). Features with
    repeated keys are an error of the source; the first by value is taken."""
    columns = [c for c in features.columns if c not in keys]
    one = features.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__f"))
    joined = atoms.join(one, keys, "left")
    value = lambda c: F.coalesce(F.col(f"__f.{c}"), F.lit(defaults.get(c)))
    return joined.withColumns({c: F.when(F.col("atom_name") == "CA", value(c)) if only_ca else value(c) for c in columns}).drop("__f")


def join_conservation(atoms: DataFrame, profiles: DataFrame) -> DataFrame:
    """(C6)"""
    return atoms.join(profiles, ["model", "pdb_name", "chain", "residue"])


def bound_to_unbound(pairs: DataFrame, names: DataFrame, unbound: DataFrame) -> DataFrame:
    """Residue pairs renamed from bound to unbound, without those of which either side is not among the unbound atoms.

    pairs: pdb_name_0, model_0, chain_0, residue_0, and the same with _1; names: bound, unbound. Names and atoms grow with the structures, and the size
    that Spark expects of atoms made by explode is that before it, so both are merged and never broadcast.
    """
    for k in (0, 1):
        key = [f"{c}_{k}" for c in ("pdb_name", "model", "chain", "residue")]
        pairs = pairs.join(names.select(F.col("bound").alias(key[0]), F.col("unbound").alias("__u")).hint("merge"), key[0]).withColumn(key[0], F.col("__u")).drop("__u")
        atoms = unbound.select(*[F.col(c[:-2]).alias(c) for c in key]).distinct()
        pairs = pairs.join(atoms.hint("merge"), key, "left_semi")
    return pairs


def ca_lookup(residues: DataFrame, atoms: DataFrame, keys: list[str]) -> DataFrame:
    """residues with aid, x, y, z of their CA (null without one) and n_ca, which is 1 in a sound structure."""
    ca = atoms.where("atom_name = 'CA'").groupBy(*keys).agg(F.min(F.struct("aid", "x", "y", "z")).alias("__c"), F.count("*").alias("n_ca"))
    return residues.join(ca, keys, "left").select(*residues.columns, "__c.aid", "__c.x", "__c.y", "__c.z", F.coalesce("n_ca", F.lit(0)).alias("n_ca"))


def cross_references(chains: DataFrame, maps: list[DataFrame], chembl: DataFrame) -> DataFrame:
    """(pdb, chain, uniprot, chembl): the maps' accessions in order without repeats, then those of the fourth map (C10). maps:
    pdb, chain, uniprot; chembl: uniprot, chembl."""
    found = functools.reduce(DataFrame.unionByName, [m.select("pdb", "chain", "uniprot", F.lit(k).alias("k")) for k, m in enumerate(maps)])
    first = found.where("uniprot is not null").groupBy("pdb", "chain", "uniprot").agg(F.min("k").alias("k"))
    linked = first.join(chembl.distinct(), "uniprot", "left")
    ordered = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("k", "uniprot", c)))), lambda x: x[c]))
    lists = linked.groupBy("pdb", "chain").agg(F.transform(F.sort_array(F.collect_set(F.struct("k", "uniprot"))), lambda x: x["uniprot"]).alias("uniprot"), ordered("chembl").alias("chembl"))
    return chains.select("pdb", "chain").distinct().join(lists, ["pdb", "chain"], "left")


def assemble_complexes(files: DataFrame, roles: tuple[str, ...] = ("ligand", "receptor"), optional: tuple[str, ...] = ("pocket",), both_forms: bool = False) -> DataFrame:
    """One row per code that has a file of each needed role (C11). files: code, role, bound, path.

    Columns are role paths, the largest path where there are several; with both_forms bound_<role> and unbound_<role>, all needed.
    """
    if both_forms:
        names = {f"{'bound' if b else 'unbound'}_{r}": (F.col("role") == r) & (F.col("bound") == F.lit(b)) for r in roles for b in (True, False)}
        needed = list(names)
    else:
        names = {r: F.col("role") == r for r in (*roles, *optional)}
        needed = list(roles)
    wide = files.groupBy("code").agg(*[F.max(F.when(c, F.col("path"))).alias(n) for n, c in names.items()])
    return wide.where(functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in needed]))


def file_pair(complexes: DataFrame) -> DataFrame:
    """(complex, id, src0, src1, src2): one pair of ligand, receptor and pocket files per complex."""
    return complexes.select(F.col("code").alias("complex"), F.lit(0).alias("id"), F.col("ligand").alias("src0"), F.col("receptor").alias("src1"), F.col("pocket").alias("src2"))


def candidates(proteins: DataFrame, compounds: DataFrame, pockets: DataFrame) -> DataFrame:
    """protein_name, compound_name, smiles, pocket_name, pocket_com: each protein with each compound, at the protein's centre and at each of its
    pockets, named pocket_1 ... by rank (C12).

    proteins: protein_name, x, y, z (of CA); compounds: compound_name, smiles; pockets: protein_name, rank, x, y, z. All pairs of a protein and a
    compound are the answer, so the pockets, which are the small side for a screen, meet each compound.
    """
    com = lambda f: F.struct(*[F.round(f(c), 3).alias(c) for c in "xyz"]).alias("pocket_com")
    centre = proteins.groupBy("protein_name").agg(com(F.avg)).select("protein_name", F.lit("protein_center").alias("pocket_name"), "pocket_com")
    number = F.row_number().over(Window.partitionBy("protein_name").orderBy("rank"))
    own = pockets.join(proteins.select("protein_name").distinct(), "protein_name", "left_semi").select("protein_name", F.concat(F.lit("pocket_"), number.cast("string")).alias("pocket_name"), com(F.col))
    return compounds.select("compound_name", "smiles").crossJoin(centre.unionByName(own)).select("protein_name", "compound_name", "smiles", "pocket_name", "pocket_com")


def pending(requested: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows that a stage has not produced yet."""
    return requested.join(produced.select(*keys).distinct(), keys, "left_anti")


#: Rows that a task makes distinct in `missing_sources`.
PART = 500_000


def missing_sources(pairs: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """(complex, path) of the sources of pairs for which there is no file (C14).

    Most sources are distinct, so they are counted and dealt into parts of about PART rows before repeats go: a task's memory does not grow with the table. The files'
    paths are hashed and the sources stream past them unsorted.
    """
    paths = pairs.select("complex", F.explode(F.array(*columns)).alias("path")).where("path is not null")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() * len(columns) // PART))
    known = files.select("path").distinct().hint("shuffle_hash")
    return paths.repartition(parts, "complex", "path").distinct().join(known, "path", "left_anti").select("complex", "path")


def expect_files(keys: DataFrame, files: DataFrame, rule: str = "one", key: str = "key") -> DataFrame:
    """(key, n) of the keys that break the rule: one, at_least_one or none."""
    broken = {"one": "n <> 1", "at_least_one": "n < 1", "none": "n > 0"}[rule]
    counted = files.groupBy(key).agg(F.count("*").alias("n"))
    return keys.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where(broken)


def require_files(keys: DataFrame, files: DataFrame, rule: str = "one", key: str = "key") -> None:
    """Raises with the first keys that break the rule."""
    broken = [r[0] for r in expect_files(keys, files, rule, key).orderBy(key).limit(20).collect()]
    if broken:
        raise FileNotFoundError(f"{rule} file expected for {broken}")


def negatives(residues_0: DataFrame, residues_1: DataFrame, positives: DataFrame, keys: list[str], full: bool = False, seed: int = 0) -> DataFrame:
    """(keys, i, j): pairs of residues of the two sides that are no positives; unless full, as many as there are positives, chosen by a hash.
    residues_0: keys, i; residues_1: keys, j; positives: keys, i, j."""
    rest = residues_0.select(*keys, "i").join(residues_1.select(*keys, "j"), keys).join(positives.select(*keys, "i", "j"), [*keys, "i", "j"], "left_anti")
    if full:
        return rest
    n = positives.select(*keys, "i", "j").distinct().groupBy(*keys).agg(F.count("*").alias("__n"))
    ranked = rest.withColumn("__k", place(keys, hash_uniform(seed, "i", "j"), "i", "j"))
    return ranked.join(n, keys).where("__k <= __n").drop("__k", "__n")


def label_matrix(residues_0: DataFrame, residues_1: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, label): 1 for positive pairs, 0 for all others."""
    marked = positives.select(*keys, "i", "j").distinct().withColumn("label", F.lit(1))
    return residues_0.select(*keys, "i").join(residues_1.select(*keys, "j"), keys).join(marked, [*keys, "i", "j"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def best_chain_match(scores: DataFrame, keys: list[str], margin: float = 20.0) -> DataFrame:
    """(keys, bound, unbound, sequence_score, rmsd): for each bound chain, of the chains whose sequence score is above the best less the
    margin, that with the lowest rmsd, ties to the smaller name (C48)."""
    best = F.max("sequence_score").over(Window.partitionBy(*keys, "bound"))
    near = scores.withColumn("__b", best).where(F.col("sequence_score") > F.col("__b") - margin)
    row = F.min_by(F.struct("unbound", "sequence_score", "rmsd"), F.struct(F.col("rmsd"), F.col("unbound"))).alias("r")
    return near.groupBy(*keys, "bound").agg(row).select(*keys, "bound", "r.*")


def unmatched_letters(chains: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, letter): chains that no match names get the next letters after those of the matched ones."""
    used = matches.groupBy(*keys).agg(F.count("*").alias("__n"))
    rest = chains.join(matches.select(*keys, F.col("unbound").alias("chain")).distinct(), [*keys, "chain"], "left_anti").join(used, keys, "left")
    number = F.coalesce("__n", F.lit(0)) + place(keys, "chain") - 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return rest.select(*keys, "chain", F.substring(F.lit(letters), (number + 1).cast("int"), F.lit(1)).alias("letter"))


def reference_numbering(alignment: DataFrame, keys: list[str]) -> DataFrame:
    """alignment with index: aligned residues share a number from 0, and gaps advance it (C49). alignment: keys, column, residue_0, residue_1."""
    return alignment.where("residue_0 is not null or residue_1 is not null").withColumn("index", F.dense_rank().over(Window.partitionBy(*keys).orderBy("column")) - 1)


def concat_tables(tables: dict[str, DataFrame], flag: str = "part") -> DataFrame:
    """Rows of all tables with the name of theirs; columns that one lacks are null (G1)."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(flag, F.lit(n)) for n, df in tables.items()])


def union_distinct(lists: list[DataFrame], key: str, order: str) -> DataFrame:
    """Keys of all lists once, with list and place of the first mention (G2). lists: key, order."""
    all_ = functools.reduce(DataFrame.unionByName, [df.select(key, order, F.lit(k).alias("list")) for k, df in enumerate(lists)])
    return all_.groupBy(key).agg(F.min(F.struct("list", order)).alias("m")).select(key, "m.list", f"m.{order}")


def except_ids(ids: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """(G3)"""
    return ids.join(drop.select(key).distinct(), key, "left_anti")


def intersect_ids(ids: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """(G4)"""
    return ids.join(keep.select(key).distinct(), key, "left_semi")


def invert_multimap(df: DataFrame, key: str, values: str) -> DataFrame:
    """(value, keys): from keys with arrays of values to values with sorted arrays of keys."""
    return df.select(key, F.explode(values).alias("value")).groupBy("value").agg(F.sort_array(F.collect_list(key)).alias("keys"))
