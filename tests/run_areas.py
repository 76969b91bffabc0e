"""Compare the queries of some areas: python tests/run_areas.py FOLDER AREA…"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

areas = {f"checks.{a}" for a in sys.argv[2:]}
chosen = {k: v for k, v in entry.queries().items() if v.__module__ in areas}
entry.queries = lambda: chosen
sys.argv = sys.argv[:2]
oracle.main()
