"""Print the formatted physical plan of registered queries (default: the headline ones) on sf0.01."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from athlos.plans.catalog import QUERIES  # noqa: E402
from athlos.session import get_spark  # noqa: E402

HEADLINE = ["iqr_clip", "lookup_join", "stratified_split", "history_seq", "class_report", "top3_classes",
            "build_lookup", "dedupe_rows"]


def main(names: list[str], sf_dir: str) -> None:
    spark = get_spark()
    for name in names or HEADLINE:
        print(f"===== {name}")
        QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01"))
