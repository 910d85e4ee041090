"""featurelab: feature selection and meta-learning on Spark DataFrames.

Layout:
  sources/    reading and writing tables, stage memoisation (A1-A5)
  functions/  shared column primitives: keyed random numbers, special
              functions, distributed ranks, fused wide aggregates (P1-P5)
  operators/  the operators of the inventory (B-L)
  plans/      fixtures built from the driver tables and the query catalogue
"""

__version__ = "0.1.0"
