"""athlos — athlete-session analytics as Spark DataFrame, SQL, MLlib and Structured Streaming operators."""

from .session import ensure_checkpoint_dir, get_spark
from .spec import INJURY_SPEC, TRAINING_SPEC, SessionSpec

__all__ = ["get_spark", "ensure_checkpoint_dir", "SessionSpec", "TRAINING_SPEC", "INJURY_SPEC"]
