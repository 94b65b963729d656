"""Composite queries (the user-facing workflow), their registry and their DuckDB twins.

* ``wide``     - timing counts, per-item comment statistics, wide and control item tables
* ``sample``   - stratified quota sample, its history and comments, ledger, two-stage sample
* ``cohort``   - item-day panel, t0, g, coverage, treated / control eligibility, universe
* ``study``    - shop / cell / item draws, post-condition checks, final study tables
* ``profile``  - histograms, shares, marker audit, distribution, percentiles, previews
* ``workflow`` - every step stored as a table (``run_sampling``, ``run_study``)
* ``registry`` - one ``(spark, sf_dir) -> DataFrame`` callable per query, on the driver's tables
* ``oracle``   - the same queries as DuckDB SQL over the same tables
"""
