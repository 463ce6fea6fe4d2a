"""What the driver's entry point registers of this subpackage."""

from corpus_pipeline import ORACLE_SQL, run
from floodspark.llm.oracle import ORACLE as _ORACLE
from floodspark.llm.queries import QUERIES as _QUERIES

QUERIES = {**_QUERIES, "pipeline": run}
ORACLE = {**_ORACLE, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
