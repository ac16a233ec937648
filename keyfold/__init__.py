"""keyfold: keyed, ordered event analytics on Spark.

Batch DataFrame queries and Structured Streaming jobs for a stock / basket
order pipeline (add-to-cart, checkout, restock), plus latency / throughput
analytics and synthetic event generation.  Everything is expressed with the
DataFrame API; Python code only runs inside Spark tasks where an ordered fold
cannot be written as a window.
"""

from keyfold.profiles import PROFILES, Profile, get_profile  # noqa: F401
