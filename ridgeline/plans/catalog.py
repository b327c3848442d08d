"""Import every query module so their queries register."""

from ridgeline.plans import q_core  # noqa: F401
from ridgeline.plans import q_clean  # noqa: F401
from ridgeline.plans import q_windows  # noqa: F401
from ridgeline.plans import q_predictions  # noqa: F401
from ridgeline.plans import q_joins  # noqa: F401
from ridgeline.plans import q_scenario  # noqa: F401
from ridgeline.plans import q_select  # noqa: F401
from ridgeline.plans import q_ml  # noqa: F401
from ridgeline.plans import q_stream  # noqa: F401
from ridgeline.plans import q_rules  # noqa: F401
from ridgeline.plans import q_files  # noqa: F401
