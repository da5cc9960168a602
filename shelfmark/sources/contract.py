"""Document contracts: fixed schemas, strictness, and the split into valid and rejected rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"keyword": "string", "text": "string", "float": "double", "integer": "int", "long": "bigint", "boolean": "boolean", "date": "timestamp", "dense_vector": "array<float>"}


@dataclass(frozen=True)
class Contract:
    """Column types, which of them may not be null, and the length of each vector column."""

    schema: T.StructType
    key: str
    required: frozenset[str] = frozenset()
    dims: tuple[tuple[str, int], ...] = ()
    hidden: frozenset[str] = frozenset()  # stored apart, not among the displayed columns

    @classmethod
    def from_mapping(cls, mapping: str | dict, key: str, required: tuple[str, ...] = ()) -> Contract:
        """From a JSON mapping with ``mappings.properties``; an unknown type is a ValueError."""
        held = json.loads(mapping) if isinstance(mapping, str) else mapping
        own = held.get("mappings", {})
        fields, dims = [], []
        for name, spec in own.get("properties", {}).items():
            if spec["type"] not in _KINDS:
                raise ValueError(f"{name}: unknown type {spec['type']}")
            fields.append(T.StructField(name, T._parse_datatype_string(_KINDS[spec["type"]]), name not in required))
            if spec["type"] == "dense_vector" and "dims" in spec:
                dims.append((name, int(spec["dims"])))
        return cls(T.StructType(fields), key, frozenset(required), tuple(dims), frozenset(own.get("_source", {}).get("excludes", [])))

    def vector_dims(self, name: str = "embedding") -> int | None:
        return dict(self.dims).get(name)

    def check_columns(self, df: DataFrame) -> None:
        """Raises ValueError for a column that isn't declared, or a required one that is missing."""
        unknown = sorted(set(df.columns) - set(self.schema.names))
        missing = sorted(self.required - set(df.columns))
        if unknown or missing:
            raise ValueError(f"undeclared columns {unknown}, missing columns {missing}")

    def problems(self, df: DataFrame) -> Column:
        """ARRAY<STRING> of what is wrong with a row."""
        found = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in df.columns if c in self.required]
        for c, n in self.dims:
            if c in df.columns:
                found.append(F.when(F.col(c).isNotNull() & (F.size(c) != n), F.concat(F.lit(f"{c} has "), F.size(c).cast("string"), F.lit(f" entries, not {n}"))))
        for f in self.schema:
            if f.name in df.columns and df.schema[f.name].dataType != f.dataType:
                cast = F.col(f.name).try_cast(f.dataType)
                found.append(F.when(F.col(f.name).isNotNull() & cast.isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid rows in the contract's types, rejected rows with ``problems``)."""
        self.check_columns(df)
        marked = df.withColumn("problems", self.problems(df))
        typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in self.schema if f.name in df.columns]
        return marked.filter(F.size("problems") == 0).select(*typed), marked.filter(F.size("problems") > 0)


def product_contract(dims: int | None = None) -> Contract:
    """The cleaned product document; with ``dims`` that of the vector index, whose title is required."""
    properties = {
        "asin": {"type": "keyword"}, "title": {"type": "text"}, "imgUrl": {"type": "keyword"}, "productURL": {"type": "keyword"}, "stars": {"type": "float"}, "reviews": {"type": "integer"},
        "price": {"type": "float"}, "listPrice": {"type": "float"}, "category_id": {"type": "keyword"}, "isBestSeller": {"type": "boolean"}, "ingested_at": {"type": "date"},
    }
    required = ["asin", "isBestSeller", "ingested_at"]
    mapping: dict = {"mappings": {"properties": properties}}
    if dims:
        properties["embedding"] = {"type": "dense_vector", "dims": dims}
        mapping["mappings"]["_source"] = {"excludes": ["embedding"]}
        required.append("title")
    return Contract.from_mapping(mapping, "asin", tuple(required))
