"""Schemas of the tables, and the check that a table has its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _I, _B, _D, _F = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.FloatType()
_LIST = T.ArrayType(_S)


def _of(base: T.StructType | None = None, **columns: T.DataType) -> T.StructType:
    return T.StructType((base.fields if base else []) + [T.StructField(n, t) for n, t in columns.items()])


PAPERS = _of(conf=_S, dblp_key=_S, title=_S, year=_I, doi=_S, authors=_LIST, ee=_S, url=_S, booktitle=_S)
VENUE = _of(PAPERS, venue=_S, has_doi=_B)
ENRICHED = _of(VENUE, abstract=_S, has_abstract=_B, text=_S, oa_concepts=_LIST, citation_count=_I, openalex_id=_S, oa_type=_S)
CORPUS = _of(conf=_S, dblp_key=_S, title=_S, year=_I, doi=_S, abstract=_S, has_abstract=_B, text=_S)
WORK = _of(id=_S, doi=_S, display_name=_S, publication_year=_I, abstract_inverted_index=T.MapType(_S, T.ArrayType(_I)), concepts=T.ArrayType(_of(display_name=_S, score=_D)), cited_by_count=_I, type=_S)
WORKS = _of(results=T.ArrayType(WORK))
UNIVERSE = _of(dblp_key=_S, conf=_S, year=_I, in_fit=_B)
TOPICS = _of(topic_id=_I, llm_label=_S, top_words=_LIST, size=_I, group=_S, group_color=_S)
PAPER_TOPICS = _of(dblp_key=_S, conf=_S, year=_I, topic_id=_I, group=_S)
REGISTRY = _of(group=_S, order=_I, color=_S, papers=_I, share=_D)
OVER_TIME = _of(topic_id=_I, top_words=_S, freq=_I, year_bucket=_I, share=_D)
VECTORS = _of(id=_I, vec=T.ArrayType(_F))
REVIEWS = _of(dblp_key=_S, title=_S, group=_S, llm_label=_S, correct=_S, error_type=_S, notes=_S)
MILESTONES = _of(status=_S, matched_topic_id=_I, delta_years=_S)
OVERRIDES = _of(dblp_key=_S, abstract=_S)
RECORD = _of(_key=_S, _publtype=_S, author=_LIST, title=_S, year=_I, ee=_LIST, url=_S, booktitle=_S)


def require_columns(df: DataFrame, columns: list[str] | T.StructType, name: str) -> DataFrame:
    """The frame itself; an error that lists the columns it lacks."""
    wanted = columns.fieldNames() if isinstance(columns, T.StructType) else columns
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df
