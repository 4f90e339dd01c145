"""tessera: raster analytics as Spark relations, plus training-data operators in :mod:`tessera.llm`."""
