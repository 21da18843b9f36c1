"""Record linkage: connected components over shared identifiers, merged records, shared submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions.text import plain_key
from concordat.store import settled


def connected(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the least reachable node. Labels spread and jump until they settle."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct())
    labels = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most_steps):
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("heard"))
        spread = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.least("root", "heard").alias("root"), F.col("root").alias("before"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = settled(spread.join(up, "root", "left").select("node", F.least("root", "above").alias("root"), "before"))
        changed = now.filter("root <> before").limit(1).count()
        labels = now.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("the components didn't settle")


def link(records: DataFrame, key: str, identifiers: list[str]) -> DataFrame:
    """records with component: the least key among those that share an identifier, directly or through others.

    identifiers: columns of one identifier each, or of arrays of them. Each identifier value joins to its least record, so
    a value that many records share gives one edge for each of them.
    """
    kinds = dict(records.dtypes)

    def named(c: str) -> Column:
        found = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.transform(found, lambda v: F.concat(F.lit(f"{c}:"), v.cast("string")))

    each = [named(c) for c in identifiers]
    values = records.select(F.col(key).alias("k"), F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in each])).alias("v")).filter("v is not null").distinct()
    least = values.groupBy("v").agg(F.min("k").alias("b"))
    roots = connected(values.join(least, "v").select(F.col("k").alias("a"), "b"))
    return records.join(roots.select(F.col("node").alias(key), F.col("root").alias("component")), key, "left").withColumn("component", F.coalesce("component", key))


def merge(records: DataFrame, order: list[Column], texts: list[str] = (), unions: list[str] = (), largest: list[str] = (), least: list[str] = (), any_true: list[str] = ()) -> DataFrame:
    """One row for each component: the first record's other values, the longest text, unions of arrays, extremes, any."""
    special = {*texts, *unions, *largest, *least, *any_true, "component"}
    rest = [c for c in records.columns if c not in special]
    position = F.struct(*order) if order else F.struct(*rest)
    longest = lambda c: F.max_by(c, F.struct(F.length(F.trim(c)), F.col(c)))
    return records.groupBy("component").agg(
        *[F.min_by(c, position).alias(c) for c in rest],
        *[longest(c).alias(c) for c in texts],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions],
        *[F.max(c).alias(c) for c in largest],
        *[F.min(c).alias(c) for c in least],
        *[F.bool_or(c).alias(c) for c in any_true],
        F.count("*").alias("n_records"),
    )


def shared_submissions(records: DataFrame, title: str = "title", unit: str = "source_unit_id", paper: str = "pmid", shortest: int = 24) -> DataFrame:
    """records with shared_submission: no paper, and a long title that another unit has too."""
    held = records.withColumn("__t", plain_key(F.col(title)))
    usable = (F.length("__t") >= shortest) & F.col(paper).isNull()
    units = F.size(F.collect_set(F.when(usable, F.col(unit))).over(Window.partitionBy("__t")))
    return held.withColumn("shared_submission", usable & (units >= 2)).drop("__t")


def source_unit_components(studies: DataFrame, key: str, papers: str) -> DataFrame:
    """studies with source_unit_id: PMID:<least> of all papers that are linked through shared studies, else the study's key."""
    linked = link(studies, key, [papers])
    least = linked.groupBy("component").agg(F.array_min(F.array_distinct(F.flatten(F.collect_list(F.transform(F.col(papers), lambda p: p.try_cast("bigint")))))).alias("__p"))
    return linked.join(least, "component").withColumn("source_unit_id", F.coalesce(F.concat(F.lit("PMID:"), F.col("__p").cast("string")), F.col(key).cast("string"))).drop("__p", "component")


def match_samples(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """columns(column) with the sample of labels(sample, title, source) that it names; null where none or several fit.

    A column that is an accession (in any case) is its own sample. Else its letters and digits must equal those of one
    sample's accession, title or source (3 or more of them), or, from 4 on, begin like one or the other way round. A label
    that several samples share names none of them.
    """
    texts = [c for c in ("sample", "title", "source") if c in labels.columns]
    keys = labels.select("sample", F.explode(F.array(*[plain_key(F.col(c)) for c in texts])).alias("sk")).filter(F.length("sk") >= 3).distinct()
    unique = keys.groupBy("sk").agg(F.min("sample").alias("sample"), F.count("*").alias("n")).filter("n = 1").drop("n")
    named = columns.select("column").distinct()
    own = named.join(labels.select("sample").distinct(), F.upper("column") == F.col("sample")).select("column", "sample")
    rest = named.join(own, "column", "left_anti").withColumn("ck", plain_key(F.col("column")))
    equal = rest.join(unique, F.col("ck") == F.col("sk")).select("column", "sample")
    rest = rest.join(equal, "column", "left_anti").filter(F.length("ck") >= 4)
    head = 4  # both keys of a prefix match begin alike, which makes it an equi-join
    near = rest.join(unique.filter(F.length("sk") >= head), (F.substring("ck", 1, head) == F.substring("sk", 1, head)) & (F.col("ck").startswith(F.col("sk")) | F.col("sk").startswith(F.col("ck"))))
    only = near.groupBy("column").agg(F.min("sample").alias("sample"), F.count_distinct("sample").alias("n")).filter("n = 1").drop("n")
    return columns.join(own.unionByName(equal).unionByName(only), "column", "left")


def accession_owners(records: DataFrame, key: str, accessions: str, order: list[Column]) -> DataFrame:
    """Each accession's first record."""
    each = records.select(key, F.explode(accessions).alias("accession"), F.struct(*order).alias("__o"))
    return each.groupBy("accession").agg(F.min_by(key, "__o").alias(key))


def candidates(records: DataFrame, by: str, order: list[Column], column: str = "candidates", keys: tuple[str, ...] = ("accession", "provider", "source_url", "name", "role", "record_type")) -> DataFrame:
    """(by, *keys, other fields) of each group's candidates: those alike by their keys are one, with the first filled value of each field.

    First is by order (total, over the records of a group), then by the place in the record's array.
    """
    fields = [f.name for f in records.schema[column].dataType.elementType.fields]
    plain = lambda f: F.trim(F.coalesce(F.col(f"c.{f}"), F.lit("")))
    normal = {f: F.upper(plain(f)) if f == "accession" else plain(f) if f == "source_url" else F.lower(plain(f)) for f in keys}
    each = records.select(by, F.struct(*order).alias("r"), F.posexplode(column).alias("p", "c")).withColumns({f"k_{f}": x for f, x in normal.items()})
    place = F.struct("r", "p")
    filled = lambda f: F.min_by(F.when(plain(f) != "", F.col(f"c.{f}")), F.when(plain(f) != "", place))
    merged = each.groupBy(by, *[f"k_{f}" for f in keys]).agg(*[filled(f).alias(f) for f in fields])
    return merged.select(by, *[F.col(f"k_{f}").alias(f) if f == "accession" else F.col(f) for f in fields])
