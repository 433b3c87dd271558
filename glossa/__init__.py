"""glossa: relate language to measured outcomes with Spark DataFrames.

Messages become long feature tables ``(group_id, feat, value, group_norm)``;
feature tables are refined, aligned with outcome / control tables and
related to them by correlation, differential, mediation and prediction
operators.  Every operator is a function ``DataFrame -> DataFrame`` built
from Spark SQL expressions; the few numeric kernels that Spark lacks
(Student-t tail, small matrix solves) run on result-sized data only.
"""

from glossa.session import get_session, checkpoint_dir  # noqa: F401

FEATURE_COLUMNS = ("group_id", "feat", "value", "group_norm")
