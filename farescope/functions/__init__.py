from farescope.functions.exprs import *  # noqa: F401,F403
