"""kharif: Spark-native market-price analytics.

Daily price observations per market, crop and variety are checked, cleaned,
rolled up, turned into calendar / lag / rolling / encoded features, fed to
Spark ML price models and scored into weekly forecasts with price bands.
Every operator is a ``DataFrame -> DataFrame`` function; the heavy work is
expressed with the DataFrame API so Catalyst plans it.
"""

from kharif.session import build_session, shared_path

__all__ = ["build_session", "shared_path"]
