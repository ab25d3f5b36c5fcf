from fleetstat.functions.expr import *  # noqa: F401,F403
from fleetstat.functions.ladder import Ladder  # noqa: F401
