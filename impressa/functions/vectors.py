"""ML vectors (P12, P13, P16), built in the JVM.

P12: ``CountVectorizerModel`` over a fixed vocabulary (the index texts), with
binary counts, turns an index array into the sparse 0/1 vector.  P13:
``array_to_vector`` over the slots in order.  P16: ``vector_to_array``.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.schema import ASIS_VECTOR_SIZE, DEFAULT_HASH_SPACE


def _index_model(df: DataFrame, size: int) -> CountVectorizerModel:
    """Count vectorizer whose vocabulary is 0..size-1 as text, passed to the JVM as one string."""
    split = df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(",").split
    model = CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel", split(",".join(map(str, range(size)))))
    return model._set(vocabSize=size)


def with_binary_vector(df: DataFrame, indices: str = "indices", size: int = DEFAULT_HASH_SPACE,
                       out: str = "features") -> DataFrame:
    """``df`` with ``out``: index array -> sparse vector of ``size`` with 1.0 at each index (null: empty)."""
    texts = "_index_texts"
    model = _index_model(df, int(size)).setInputCol(texts).setOutputCol(out).setBinary(True)
    named = F.coalesce(F.col(indices).cast("array<string>"), F.array().cast("array<string>"))
    return model.transform(df.withColumn(texts, named)).drop(texts)


def asis_vector(features: Column, size: int = ASIS_VECTOR_SIZE) -> Column:
    """Parsed LibSVM pairs ARRAY<STRUCT<idx, val>> -> vector of ``size`` with val at idx, else 0.

    Index 0 stays unused (indices are 1-based, never shifted); a row without
    features gives zeros.
    """
    pairs = F.col(features) if isinstance(features, str) else features
    kv = F.map_from_entries(pairs)
    return slots_vector([F.lit(None)] + [F.try_element_at(kv, F.lit(i)) for i in range(1, int(size))])


def slots_vector(slots: list[Column]) -> Column:
    """Vector of the given slots in order; null slots are 0."""
    return array_to_vector(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in slots]))


def positive_probability(probability: str = "probability") -> Column:
    """Probability of class 1 as a DOUBLE."""
    return vector_to_array(F.col(probability))[1]
