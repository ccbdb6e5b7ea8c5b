"""Schemas of the mesh tables."""

from pyspark.sql import types as T

NODES = T.StructType([T.StructField("node_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "xyz")])
ELEMENTS = T.StructType([T.StructField("elem_id", T.LongType()), T.StructField("etype", T.StringType()), T.StructField("nodes", T.ArrayType(T.LongType()))])
FACETS = T.StructType(
    [T.StructField("facet_id", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("bound", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("elem_id", T.LongType()), T.StructField("orient", T.LongType())]
)
BOUND_NODES = T.StructType([T.StructField("bound", T.LongType()), T.StructField("node_id", T.LongType())])
VECTOR = T.StructType([T.StructField("idx", T.LongType()), T.StructField("val", T.DoubleType())])
FIELDS = ("ux", "uy", "uz", "p", "phi", "temp")
RATES = ("dux", "duy", "duz", "dp", "dphi", "dtemp")
STATE = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("node_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in (*FIELDS, *RATES))])
PARTICLES = T.StructType(
    [T.StructField("step", T.IntegerType()), T.StructField("pid", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("coord", "vel", "acc")), T.StructField("mass", T.DoubleType()), T.StructField("radius", T.DoubleType())]
)
CORNERS = {"tet": 4, "prism": 6, "hex": 8}
TABLES = {"nodes": NODES, "elements": ELEMENTS, "facets": FACETS, "bound_nodes": BOUND_NODES}

# fixed values: material and time-step constants
RHO, CP, KAPPA, MU, DT = 1.0e3, 1.0, 0.66, 10.0 / 3.0, 5e-2
RHO_C = 0.5
ALPHA_M, ALPHA_F = (3.0 - RHO_C) / (1.0 + RHO_C), 1.0 / (1.0 + RHO_C)
GAMMA = 0.5 + ALPHA_M - ALPHA_F
F1, F2 = ALPHA_M, DT * ALPHA_F * GAMMA
