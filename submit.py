"""Fit one of the known data sets: spark-submit submit.py <name> <folder> [options]."""

from rowgrad.plans.job import main

if __name__ == "__main__":
    main()
