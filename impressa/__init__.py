"""impressa: click-log preparation, sampling, learning and evaluation on Spark.

Every operator is a DataFrame transformation (``DataFrame -> DataFrame``) or a
Column expression builder, so Catalyst sees one plan per job.  See README.md
for the module map.
"""

from impressa.session import get_session, staging_dir

__all__ = ["get_session", "staging_dir"]
