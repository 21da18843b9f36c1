"""Classifiers of file names, table headers, samples and species, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import field
from concordat.operators.ranking import global_rank

# Patterns of file names, without regard to case.
REJECTED = r"raw\.tar|\.mtx(?:\.gz)?$|\.h5(?:ad)?$|barcodes|features\.tsv|\.bam(?:\.gz)?$|\.bed(?:\.gz)?$|\.bw$|\.bigwig$|fastq|readme|filelist"
STRONG = r"deseq|edger|limma|(?:^|[_\-.])deg(?:[_\-.]|$)|differential|diff[_\-.]?exp|gene[_\-.]?exp\.diff|toptable|(?:^|[_\-.])dge(?:[_\-.]|$)|(?:^|[_\-.])dea(?:[_\-.]|$)"
COUNTS = r"raw[_\-.]?counts?|count[_\-.]?matrix|counts?[_\-.]?(?:table|data)|_counts?\."
EXPRESSION = r"series[_-]?matrix|normalized[_\-.]?(?:expression|intensity)|expression[_\-.]?matrix|rlog|vst|fpkm|rpkm|tpm"
WEAK = r"processed|compare|table[_\-.]?s?\d*|results?|supplement|analysis"
TABULAR = r"\.(csv|tsv|txt)(\.gz)?$|\.xlsx$"
# Patterns of column names, without regard to case.
GENE_EXACT = r"^(gene|gene[_. ]?id|gene[_. ]?name|gene[_. ]?symbol|symbol|hgnc.*|hugo.*|ensembl.*|geneid)$"
GENE_LOOSE = r"gene|symbol|hgnc|hugo|ensembl|entrez|probe|transcript|(?:^|_)id$"
LFC_CLEAR = r"log2[\W_]*fold[\W_]*change|log2fc|log[_. ]?fc|log2ratio"
LFC_UNCLEAR = r"fold[_. ]?change|foldchange|(?:^|_)beta$|effect[_. ]?size"
PADJ = r"padj|adj[_. ]?p|adjusted[_. ]?p|fdr|q[_. ]?value|qvalue|qval"
PVALUE = r"p[_. ]?value|pvalue|pval|p_val|^p$"
NOT_SAMPLE = r"^(?:gene[_. ]?)?(?:start|stop|end|length|strand|chrom(?:osome)?|chr)|^(?:description|annotation|biotype|entrez|transcript|feature|base[_. ]?mean|mean|average|avg|ave[_. ]?expr|age|batch|sex|gender|quality|qc|group|condition|phenotype|class)|(?:log2?[_. ]?fc|fold[_. ]?change|p[_. ]?value|pval|padj|adj[_. ]?p[_. ]?val|fdr|q[_. ]?value|stat(?:istic)?|score|stderr|std[_. ]?error|se|df|degrees[_. ]?of[_. ]?freedom)$|^(?:t|b)$"
STATISTIC = r"^(?:ave[_. ]?expr|t|b|stat(?:istic)?|score|log2?[_. ]?fc|fold[_. ]?change|p[_. ]?value|pval|padj|adj[_. ]?p[_. ]?val|fdr|q[_. ]?value)$"
SAMPLE = r"^(?:GSM|SRR|ERR|DRR)\d+$|(?:^|[_ .-])(?:ctrl|control|case|treat(?:ed|ment)?|vehicle|untreated|baseline|wt|ko|knockout|hypox\w*|normox\w*|hox|nox|rep(?:licate)?|sample|donor|patient|subject|culture)(?:[_ .-]?\w+)*$"
# Names of the two target species, labels that say nothing.
SPECIES = {
    "Human": ("human", "homo sapiens", "hs", "h sapiens", "9606"),
    "Mouse": ("mouse", "mus musculus", "mm", "m musculus", "10090"),
}
NO_SPECIES = ("unknown", "not reported", "not available", "mixed", "multiple", "other")


def _like(value: Column, pattern: str) -> Column:
    return value.rlike(f"(?i){pattern}")


def file_name(address: Column) -> Column:
    """The last part of an address's path, percent signs resolved, in lower case."""
    path = F.regexp_replace(F.regexp_replace(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    return F.lower(F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B"))))


def filename_class(address: Column) -> Column:
    """struct(tier, role, inspectable, reason) by the name alone; the first pattern that fits decides."""
    name = file_name(address)
    tabular = _like(name, TABULAR)
    kinds = [  # pattern, tier, role, reason
        (_like(name, REJECTED), "reject", "unsupported", "sequences, an archive, a sparse matrix or notes"),
        (_like(name, COUNTS), "upstream", "count_matrix", "a count matrix by its name; groups and contrast are needed"),
        (_like(name, EXPRESSION), "upstream", "normalized_expression_matrix", "an expression matrix by its name; scale, annotation and groups are needed"),
        (_like(name, STRONG), "strong", "deg_table", "the name speaks of differential expression"),
        (tabular & _like(name, WEAK), "weak", "unknown_table", "a processed or supplementary table by its name"),
        (tabular, "weak", "unknown_table", "a table whose name says nothing"),
    ]

    def first(k: int, otherwise: str) -> Column:
        out = F.lit(otherwise)
        for kind in reversed(kinds):
            out = F.when(kind[0], kind[k]).otherwise(out)
        return out

    return F.struct(first(1, "unsupported").alias("tier"), first(2, "unsupported").alias("role"), (tabular & ~_like(name, REJECTED)).alias("inspectable"), first(3, "not a table, or of an unsupported type").alias("reason"))


def header_class(columns: Column) -> Column:
    """What an array of column names can be mapped to.

    struct(status, reason, gene, lfc, p, padj, gene_columns, lfc_columns, p_columns, padj_columns, lfc_scale_explicit)
    """
    names = F.filter(F.transform(columns, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan"))
    pick = lambda pattern: F.filter(names, lambda x: _like(x, pattern))
    first = lambda found: F.get(found, F.lit(0))
    clear = pick(LFC_CLEAR)
    unclear = F.filter(pick(LFC_UNCLEAR), lambda x: ~_like(x, LFC_CLEAR))
    effects = F.concat(clear, unclear)
    padj = pick(PADJ)
    p = F.filter(pick(PVALUE), lambda x: ~_like(x, PADJ))
    exact = pick(GENE_EXACT)
    genes = F.when(F.size(exact) > 0, exact).otherwise(pick(GENE_LOOSE))
    gene, lfc = first_gene(genes), first(effects)
    whole = gene.isNotNull() & lfc.isNotNull()
    several = (F.size(effects) > 1) | (F.size(p) > 1)
    cases = [
        (whole & (F.size(p) > 0) & several, "requires_column_mapping", "several effect or p-value columns: map one contrast"),
        (whole & (F.size(p) > 0) & (F.size(clear) > 0), "candidate_header", "columns of gene, log2 fold change and p-value"),
        (whole & (F.size(p) > 0), "requires_lfc_confirmation", "the effect's scale isn't said to be log2"),
        (whole & (F.size(padj) > 0), "requires_pvalue_mapping", "only adjusted p-values are there"),
    ]
    status, reason = F.lit("not_deg_table"), F.lit("no column of gene, log2 fold change or p-value")
    for fits, s, r in reversed(cases):
        status, reason = F.when(fits, s).otherwise(status), F.when(fits, r).otherwise(reason)
    return F.struct(
        status.alias("status"), reason.alias("reason"), gene.alias("gene"), lfc.alias("lfc"), first(p).alias("p"), first(padj).alias("padj"),
        genes.alias("gene_columns"), effects.alias("lfc_columns"), p.alias("p_columns"), padj.alias("padj_columns"), (F.size(clear) > 0).alias("lfc_scale_explicit"),
    )


def first_gene(names: Column) -> Column:
    """Of column names that may hold entities the one that most likely does: symbols, then ids, then others, by name."""
    priority = lambda x: F.when(_like(x, r"symbol|hgnc|hugo|gene[_. ]?name"), 0).when(_like(x, r"ensembl|gene[_. ]?id|geneid"), 1).when(F.lower(x) == "gene", 2).when(F.lower(x) == "id_ref", 3).otherwise(4)
    ordered = F.array_sort(F.transform(names, lambda x, k: F.struct(priority(x).alias("p"), F.lower(x).alias("l"), k.alias("k"), x.alias("x"))))
    return F.get(ordered, F.lit(0))["x"]


def looks_like_sample(name: Column) -> Column:
    """Whether a column's name is that of a sample: a group or replicate word, an accession, or anything with a digit."""
    text = F.trim(name)
    return (text != "") & ~_like(text, NOT_SAMPLE) & (_like(text, SAMPLE) | text.rlike(r"\d"))


def numeric_share(values: Column, unit_interval: bool = False) -> Column:
    """The share of an array's non-missing texts that are finite numbers (in [0, 1])."""
    seen = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~F.lower(x).isin("", "na", "nan", "null", "none"))
    good = F.filter(seen, lambda x: F.coalesce((F.abs(x.try_cast("double")) < float("inf")) & (x.try_cast("double").between(0, 1) if unit_interval else F.lit(True)), F.lit(False)))
    return F.coalesce(F.try_divide(F.size(good).cast("double"), F.size(seen)), F.lit(0.0))


def species(label: Column) -> Column:
    """Human, Mouse, Taxon:<number> or Other:<label>; null for a label that says nothing."""
    raw = F.regexp_replace(field(label), r"\s+", " ")
    key = F.translate(F.lower(raw), "_-", "  ")
    rest = F.trim(F.regexp_replace(raw, "^[^:]*:", ""))
    named = lambda kind, text: F.when(text != "", F.concat(F.lit(f"{kind}:"), text))
    sentence = lambda text: F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000)))
    out = F.when(key.startswith("other:"), named("Other", sentence(rest))).when(key.startswith("taxon:"), named("Taxon", rest)).when(key.isin(*NO_SPECIES), None).when(key.rlike("^[0-9]+$"), F.concat(F.lit("Taxon:"), key)).otherwise(named("Other", sentence(raw)))
    for name, labels in SPECIES.items():
        out = F.when(key.isin(*labels), name).otherwise(out)
    return out


def species_decision(labels: Column, target: str, verified: Column, quarantined: Column, blocked: Column, evidence: Column) -> Column:
    """What the species labels of a record, its flags and its evidence text mean for a target.

    A mixed record counts only if the target was verified and there is evidence of it.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    seen = F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))
    mixed = (F.size(seen) > 1) | flag(quarantined)
    rescued = F.when(field(evidence).isNotNull(), "mixed_rescued").otherwise("mixed_quarantined")
    return (
        F.when(flag(blocked), "mixed_quarantined")
        .when(flag(verified) & mixed, rescued)
        .when(flag(quarantined), "mixed_quarantined")
        .when(flag(verified), "target_species_verified")
        .when(F.size(seen) == 0, "unknown")
        .when(F.array_contains(seen, target), F.when(F.size(seen) == 1, "target_species_likely").otherwise("mixed_quarantined"))
        .otherwise("non_target")
    )


def publication_rank(records: DataFrame, sort: str = "readiness", descending: bool = False) -> DataFrame:
    """records with rank: by readiness (priority, relevance, newest, id), relevance, year (newest first) or title.

    descending turns the chosen key around, not the ties behind it.
    """
    newest = F.col("year").desc_nulls_last()
    orders = {"readiness": (F.col("priority"), False, [F.col("relevance_rank"), newest]), "relevance": (F.col("relevance_rank"), False, []), "year": (F.col("year"), True, [F.col("relevance_rank")]), "title": (F.lower("title"), False, [])}
    if sort not in orders:
        raise ValueError(f"sort must be one of {sorted(orders)}")
    key, down, then = orders[sort]
    return global_rank(records, key, [*then, F.col("record_id")], "rank", descending=down != descending)


def identifiers(records: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, type, identifier) of each identifier column or array, distinct."""
    kinds = dict(records.dtypes)

    def typed(c: str) -> Column:
        found = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.transform(found, lambda v: F.struct(F.lit(c).alias("type"), v.cast("string").alias("identifier")))

    each = [typed(c) for c in columns]
    return records.select(key, F.explode(F.concat(*each)).alias("x")).select(key, "x.*").filter("identifier <> ''").distinct()
