"""veilwork: anonymize tables and streams with Spark DataFrames.

Sub-packages:

* ``functions``  column expressions (digests, masks, tokens, noise, patterns)
* ``sources``    scans, catalogs, policy documents, logs, sinks
* ``operators``  DataFrame-to-DataFrame operators (apply, detect, integrity ...)
* ``plans``      policy, risk, validation, audit and report jobs
* ``streaming``  incremental sync and change application
* ``queries``    the registered queries with their reference SQL
"""

__version__ = "0.1.0"
