"""glyphmill: PySpark-native analytics over recognition-pipeline tables."""
