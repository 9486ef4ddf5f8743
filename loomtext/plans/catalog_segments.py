"""Queries of the segmented positional index."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import segments as G
from loomtext.registry import query
from loomtext.runtime import Scratch
from loomtext.sources import corpus as C

_PLACES = "SELECT file_id, CAST(sum(length(piece) + {n}) OVER (PARTITION BY file_id ORDER BY i) - {n} AS INTEGER) AS start, i, m FROM (SELECT doc_id AS file_id, unnest(string_split(text, '{lit}')) AS piece, generate_subscripts(string_split(text, '{lit}'), 1) AS i, len(string_split(text, '{lit}')) AS m FROM {table}) s"


@query(f"SELECT file_id, start FROM ({_PLACES.format(lit='heit der', n=8, table='documents')}) WHERE i < m")
def index_literal_positions(spark, sf_dir):
    """Every place of a literal, from trigram positions alone."""
    return G.literal_positions(G.positions(C.files(spark, sf_dir)), "heit der")


@query(f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' || text || 'leau' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3) SELECT file_id, start FROM ({_PLACES.format(lit='leau', n=4, table='d')}) WHERE i < m")
def index_segments(spark, sf_dir):
    """An index built in five batches: parts of the corpus, then changed files and removed ones, merged on the way."""
    corpus = C.files(spark, sf_dir).select("file_id", "content")
    index = G.Segments(spark, f"{Scratch(spark, 'segments').root}/index", buckets=8, fanout=2)
    for part in range(3):
        index.add(corpus.where(F.col("file_id") % 3 == part))
        index.merge()
        index.clean()
    changed = corpus.where("file_id % 5 = 0").withColumn("content", F.concat(F.lit("x"), "content", F.lit("leau")))
    index.add(changed.where("file_id % 2 = 0"))
    index.add(changed.where("file_id % 2 = 1 AND file_id % 7 != 3"), corpus.where("file_id % 7 = 3"))
    index.merge()
    index.clean()
    return index.find("leau")
