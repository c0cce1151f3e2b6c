from farescope.sources.scans import *  # noqa: F401,F403
