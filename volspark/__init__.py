"""Volumetric images, deformation fields and imaging metadata as Spark DataFrames."""
