"""Launcher for the batch jobs: ``spark-submit --py-files fleetstops.zip run_job.py fleet|ingest ...``."""

from fleetstops.plans.jobs import main

if __name__ == "__main__":
    main()
