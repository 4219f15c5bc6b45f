"""Plumbline: messy tables in, trusted numbers out, as Spark jobs.

Every operator takes DataFrames and returns DataFrames.  The layers are

* ``functions``  - scalar column expressions
* ``sources``    - readers, writers and snapshots
* ``operators``  - cleaning, profiling, validation, metrics, insights, text
* ``plans``      - jobs composed from operators
* ``streaming``  - the row-wise cleaning operators on a stream
"""

__version__ = "0.1.0"
