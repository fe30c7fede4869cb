"""cadence: workload analytics and forecasting data work on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function built on built-in
Spark SQL expressions. Most are lazy; ordered operators first write their input in
ranges to the shared folder, and one-hots without given categories list them. Sub-packages:

* ``sources``   – typed readers, derived stand-in tables, sinks
* ``functions`` – scalar column expressions (time parsing, names, labels, arrays)
* ``operators`` – relational operators (cleaning, features, splits, scaling,
                  sequences, series, forecasting, evaluation, federated, metrics)
* ``plans``     – end-to-end compositions (training windows for the busiest series)
* ``streaming`` – Structured Streaming forms of the feature / rate / gauge queries
"""

from cadence.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
