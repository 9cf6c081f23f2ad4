"""varieta — text-dataset preparation and classifier evaluation on Spark.

Everything is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function
built from Spark SQL expressions, windows, joins and aggregations.  No
operator triggers an action; callers decide when to execute.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python tasks (Arrow UDFs, ``applyInPandas``) unpickle the functions
    they run.  Pickling this package's functions by value lets them run on
    workers where the package is not installed or not on the path."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pickler: workers need the package on their path
        pass


_ship_by_value()
