"""tillroll: retail and e-commerce analyses as Spark DataFrame jobs.

Every analysis is a plain function from DataFrames plus explicit parameters
(an ``as_of`` date stands in for "today") to a DataFrame.  The functions only
declare the logical plan; Catalyst and adaptive query execution pick the
physical strategy.
"""

__version__ = "0.1.0"
