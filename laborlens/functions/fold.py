"""Unicode compatibility folding (NFKC), which Spark SQL lacks: one Arrow kernel, a call for each batch."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKC")
