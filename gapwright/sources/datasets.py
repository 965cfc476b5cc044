"""Declared datasets, and readers and writers of their files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DatasetSpec:
    """Columns with their roles, and how a raw file is written."""

    name: str
    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    target: str
    positive: str
    sensitive: str
    separator: str = ","
    null_value: str = "?"
    ignore: tuple[str, ...] = field(default=())

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.columns if c not in (*self.numeric, self.target, *self.ignore)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.DoubleType() if c in self.numeric else T.StringType()) for c in self.columns])

    def label(self) -> Column:
        return (F.trim(self.target) == self.positive).cast("int")


# The columns of two public datasets.
ADULT = DatasetSpec(
    "adult_census",
    ("age", "workclass", "education", "education_num", "marital_status", "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "income"),
    ("age", "education_num", "capital_gain", "capital_loss", "hours_per_week"), "income", ">50K", "sex",
)
GERMAN = DatasetSpec(
    "german_credit",
    ("checking_status", "duration", "credit_history", "purpose", "credit_amount", "savings_status", "employment", "installment_rate", "personal_status", "other_debtors", "present_residence", "property", "age", "other_installment", "housing", "existing_credits", "job", "dependents", "telephone", "foreign_worker", "target"),
    ("duration", "credit_amount", "installment_rate", "present_residence", "age", "existing_credits", "dependents"), "target", "2", "personal_status", separator=" ",
)


def read_table(spark: SparkSession, spec: DatasetSpec, path: str, header: bool = True) -> DataFrame:
    """A delimited file by its declared schema: trimmed strings, declared nulls, NaN as null."""
    raw = spark.read.schema(spec.schema).csv(path, header=header, sep="," if header else spec.separator, nullValue="" if header else spec.null_value, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in spec.numeric else F.trim(c).alias(c) for c in spec.columns))


def write_raw(df: DataFrame, spec: DatasetSpec, path: str) -> None:
    """A headerless file with the declared separator and mark for nulls."""
    df.select(*spec.columns).write.csv(path, header=False, sep=spec.separator, nullValue=spec.null_value)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
