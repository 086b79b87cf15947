"""Entity tables with explicit schemas, read from Parquet or a database, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemark.session import spread
from sourcemark.sources.files import parse_document

# The entity tables and their columns (times are UTC timestamps).
_PAGE_SPANS = "array<struct<page_number:int,char_start:int,char_end:int>>"
_GEOMETRY = (
    "array<struct<page_number:int,width:double,height:double,"
    "runs:array<struct<char_start:int,top:double,bottom:double,x:array<array<double>>>>>>"
)
_EVIDENCE = (
    "struct<quote:string,char_start:int,char_end:int,page:int,match_kind:string,is_ambiguous:boolean>"
)
_CLAIM = f"struct<value:string,evidence:{_EVIDENCE}>"
_DROPPED = "array<struct<field:string,value:string,quote:string,reason:string>>"
_STATS = (
    "struct<verified:int,dropped:int,by_match_kind:map<string,int>,"
    "by_reject_reason:map<string,int>,attempts:int>"
)
_PROFILE = (
    f"struct<full_name:{_CLAIM},headline:{_CLAIM},years_experience:{_CLAIM},seniority:string,"
    f"seniority_evidence:{_EVIDENCE},skills:array<{_CLAIM}>,"
    f"experiences:array<struct<company:string,title:string,start:string,end:string,evidence:{_EVIDENCE}>>,"
    f"education:array<struct<institution:string,credential:string,evidence:{_EVIDENCE}>>,"
    f"dropped:{_DROPPED},stats:{_STATS}>"
)
_JUDGMENT = (
    "struct<requirements:array<struct<requirement_id:string,label:string,must_have:boolean,"
    f"weight:double,verdict:string,evidence:array<{_EVIDENCE}>>>,dropped:{_DROPPED},stats:{_STATS}>"
)
_TIMES = "created_at timestamp, updated_at timestamp"

TABLES = {
    "candidates": "id string, email string, display_name string, password_hash string, role string, "
    f"token_epoch int, {_TIMES}",
    "resumes": "id string, candidate_id string, filename string, content_hash string, size_bytes int, "
    "storage_key string, status string, failure_reason string, attempts int, failed_attempts int, "
    "last_attempt_at timestamp, page_count int, pages_without_text array<int>, pages_from_ocr array<int>, "
    "document_text string, consented_at timestamp, consent_version string, "
    f"page_spans {_PAGE_SPANS}, page_geometry {_GEOMETRY}, {_TIMES}",
    "extracted_profiles": f"id string, resume_id string, profile {_PROFILE}, claims_verified int, "
    f"claims_dropped int, hallucination_rate double, attempts int, {_TIMES}",
    "llm_call_logs": "id string, resume_id string, screening_id string, provider string, model string, "
    "prompt_version string, attempt int, input_tokens int, output_tokens int, cached_input_tokens int, "
    f"latency_ms int, cost_usd double, {_TIMES}",
    "jobs": "id string, owner_id string, title string, description string, status string, "
    f"published_at timestamp, location string, {_TIMES}",
    "job_requirements": "id string, job_id string, position int, kind string, label string, "
    f"detail string, must_have boolean, weight double, {_TIMES}",
    "screenings": "id string, job_id string, resume_id string, status string, failure_reason string, "
    "attempts int, failed_attempts int, last_attempt_at timestamp, requirements_hash string, "
    f"prompt_version string, result {_JUDGMENT}, requirements_met int, requirements_total int, "
    f"claims_verified int, claims_dropped int, hallucination_rate double, {_TIMES}",
    "applications": f"id string, job_id string, candidate_id string, resume_id string, state string, {_TIMES}",
    "application_events": "id string, application_id string, position int, from_state string, "
    "to_state string, actor_id string, actor_role string, reason string, screening_id string, "
    f"note string, {_TIMES}",
}
# The closed vocabularies of the string columns.
VOCABULARIES = {
    "resume_status": ("pending", "processing", "parsed", "extracted", "failed", "dead_lettered"),
    "screening_status": ("pending", "processing", "completed", "failed", "dead_lettered"),
    "job_status": ("draft", "published", "closed"),
    "role": ("candidate", "recruiter", "admin"),
    "requirement_kind": ("skill", "experience", "education", "language", "other"),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An entity table under ``root``; only the columns and rows asked for are read."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_table_jdbc(
    spark: SparkSession, url: str, name: str, split_column: str, bounds: tuple, partitions: int, **options: str
) -> DataFrame:
    """The same table from a database, split on ``split_column`` so no single task reads it all."""
    lower, upper = (str(bound) for bound in bounds)
    return as_entity(
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=split_column, **options)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", str(partitions))
        .load(),
        name,
    )


def as_entity(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a database as the entity's columns: JSON text becomes nested, all else its declared type."""
    kinds = dict(rows.dtypes)

    def column(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        if nested and kinds[field.name] == "string":
            return parse_document(F.col(field.name), field.dataType).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return rows.select(*[column(field) for field in T.StructType.fromDDL(TABLES[name])])


def outside_vocabulary(df: DataFrame, column: str, vocabulary: str) -> DataFrame:
    """Rows whose value is none of the allowed ones (null included)."""
    return df.where(~F.coalesce(F.col(column).isin(*VOCABULARIES[vocabulary]), F.lit(False)))


# Tables whose rows hold whole texts, with the key their rows are dealt by.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the benchmark tables the registered queries run on."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df
