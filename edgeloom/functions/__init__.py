from edgeloom.functions.columns import *  # noqa: F401,F403
from edgeloom.functions.constants import *  # noqa: F401,F403
