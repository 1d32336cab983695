"""A PySpark-native analytics engine for Han characters, CJK readings and bilingual dictionaries."""
