"""trialstats — trial-log and event-sequence analytics on Spark DataFrames.

Sub-packages:

* ``sources``   — folder CSV scans with unlike headers, driver tables, sinks (S1-S4)
* ``functions`` — column-level helpers: casts, recodes, t / chi-square quantiles (X, F, P11)
* ``operators`` — DataFrame operators: columns, missing data, ordered scans, joins,
                  reshape, statistics, outliers (P, N, W, J, R, O, A, M)
* ``plans``     — trial coding, metrics, checks, and the query catalogue (D, E, Q)
"""

__version__ = "0.1.0"
