"""Queries over paged record lists made of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from concordat.operators.ranking import global_rank
from concordat.plans.bridge import table
from concordat.plans.queries import query
from concordat.sources import paged
from concordat.store import shared_folder

SIZE = 500


def _pages(spark: SparkSession, sf: str) -> str:
    """Orders as a provider's list: some are no series, some have several organisms, some come twice."""
    k = F.col("o_orderkey")
    accession = F.concat(F.when(k % 13 == 0, "gds").otherwise("gse"), F.expr("o_orderkey div 3").cast("string"))
    taxon = F.when(k % 5 == 0, "Homo sapiens; Mus musculus").when(k % 7 == 0, F.lit(None).cast("string")).otherwise("Homo sapiens ")
    rows = table(spark, sf, "orders").select("o_orderkey", accession.alias("accession"), taxon.alias("taxon"), F.col("o_orderpriority").alias("title"))
    placed = global_rank(rows, k, [], "place").withColumn("position", F.col("place").cast("bigint") - 1)
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    paged.write_pages(placed.select("position", "accession", "taxon", "title"), folder, SIZE)
    return folder


_SEEN = """select row_number() over (order by o_orderkey) - 1 as position, case when o_orderkey % 13 = 0 then 'GDS' else 'GSE' end || o_orderkey // 3 as accession,
  case when o_orderkey % 13 = 0 then 'not_a_geo_series' when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 'mixed_or_mismatched_organism' else '' end as fault from orders"""
_JUDGED = f"select position, accession, case when fault <> '' then fault when position > min(position) filter (fault = '') over (partition by accession) then 'duplicate_exact_accession' else '' end as reason from ({_SEEN})"
_RANKED = f"select *, case when reason = '' then row_number() over (partition by reason = '' order by position) end as rank from ({_JUDGED})"


@query(f"select position, accession, reason, rank::int as rank from ({_RANKED})")
def paged_records(spark, sf):
    """The whole list, read as a stream of pages: what was kept, and why all else wasn't."""
    return paged.scan(spark, _pages(spark, sf), SIZE, "Homo sapiens").select("position", "accession", "reason", "rank")


@query(f"""select case when rank = 1001 then 'beyond_limit' else reason end as reason, count(*) as n from ({_RANKED})
where position <= coalesce((select position from ({_RANKED}) where rank = 1001), 9223372036854775807) group by 1""")
def paged_counts(spark, sf):
    """The counters of a search that keeps a thousand records and looks for one more."""
    return paged.counts(paged.scan(spark, _pages(spark, sf), SIZE, "Homo sapiens", limit=1000, step=4))
