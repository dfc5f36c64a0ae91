"""Check the queries of one or more plan modules: python tools/check_module.py sf module ..."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import check_oracles  # noqa: E402

from tallyforge.plans.registered import QUERIES  # noqa: E402

sf, mods = sys.argv[1], tuple(sys.argv[2:])
sys.argv = ["check", sf] + [n for n, f in QUERIES.items() if f.__module__.endswith(mods)]
check_oracles.main()
