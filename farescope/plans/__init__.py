from farescope.plans.search import *  # noqa: F401,F403
