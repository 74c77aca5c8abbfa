"""Registered queries: each module pairs Spark builders with SQL twins."""

from tabwise.plans.catalog import profile_q  # noqa: F401
from tabwise.plans.catalog import clean_q  # noqa: F401
from tabwise.plans.catalog import metrics_q  # noqa: F401
from tabwise.plans.catalog import features_q  # noqa: F401
from tabwise.plans.catalog import split_q  # noqa: F401
from tabwise.plans.catalog import ml_q  # noqa: F401
from tabwise.plans.catalog import explain_q  # noqa: F401
from tabwise.plans.catalog import io_q  # noqa: F401
from tabwise.plans.catalog import image_q  # noqa: F401
