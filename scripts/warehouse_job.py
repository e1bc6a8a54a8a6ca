"""spark-submit entry for the warehouse jobs (see ``stagehand.jobs``).

    spark-submit --py-files stagehand.zip scripts/warehouse_job.py stage RAW_DIR STG_DIR
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagehand.jobs import main  # noqa: E402

if __name__ == "__main__":
    main()
