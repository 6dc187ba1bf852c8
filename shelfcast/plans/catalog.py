"""Importing this module registers every job."""

from . import q_panel  # noqa: F401
from . import q_backtest  # noqa: F401,E402
from . import q_plan  # noqa: F401,E402
from . import q_policy  # noqa: F401,E402
from . import q_quality  # noqa: F401,E402
from . import q_parts  # noqa: F401,E402
from . import q_weekly  # noqa: F401,E402
from . import q_reports  # noqa: F401,E402
from . import q_stream  # noqa: F401,E402
from . import q_extra  # noqa: F401,E402
from . import q_io  # noqa: F401,E402
