"""ontoloom: a PySpark-native analytics engine for knowledge graphs, the texts
they come from and the logs of the process that built them."""
