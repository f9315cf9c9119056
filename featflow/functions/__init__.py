"""Pure Column -> Column expressions. Nothing here runs a job."""

from featflow.functions.parse import *  # noqa: F401,F403
from featflow.functions.features import *  # noqa: F401,F403
