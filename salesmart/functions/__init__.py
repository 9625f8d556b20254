"""Column functions: measures, flags, dates, text formats."""

from salesmart.functions.columns import *  # noqa: F401,F403
from salesmart.functions.text import *  # noqa: F401,F403
