"""python -m pathval.cli CONTRACT.py --model MODEL.json: values a contract and prints the report."""

from __future__ import annotations

import argparse
import json

from pathval.api import FACTOR, LIMIT, PATHS, calc


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pathval", description="Value a contract.")
    p.add_argument("contract", help="file with the contract's source")
    p.add_argument("--model", help="JSON file with market, sigma, rho, curve")
    p.add_argument("--observation-date")
    p.add_argument("--interest-rate", type=float, default=0.0)
    p.add_argument("--path-count", type=int, default=PATHS)
    p.add_argument("--perturbation-factor", type=float, default=FACTOR)
    p.add_argument("--periodisation", choices=["alltime", "yearly", "monthly", "daily"])
    p.add_argument("--max-dependency-graph-size", type=int, default=LIMIT)
    p.add_argument("--timeout", type=float)
    p.add_argument("--single-sided-deltas", action="store_true")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    with open(a.contract) as f:
        source = f.read()
    model = None
    if a.model:
        with open(a.model) as f:
            model = json.load(f)
    print(calc(source, a.observation_date, a.interest_rate, a.path_count, a.perturbation_factor, model, a.periodisation, None, a.max_dependency_graph_size, a.timeout, not a.single_sided_deltas, a.verbose, seed=a.seed))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
