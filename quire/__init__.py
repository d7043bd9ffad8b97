"""quire: documentation-corpus jobs on Spark.

functions/  Column -> Column expressions (URLs, HTML, registry times)
sources/    scans of tables, JSON registries and file listings
operators/  DataFrame -> DataFrame jobs (classify, links, crawl, resolve,
            stores, files, render, markdown, bundles, retrieve)
plans/      the registered queries, their DuckDB oracles, the full ingest
streaming/  the page classifier on a file stream
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (the
    mapInPandas steps) need no installed copy of it -- the same effect as
    shipping it with --py-files."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: rely on the workers' import path
        pass


_ship_by_value()
