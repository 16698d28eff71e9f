"""kindsort: inventory classification and reporting on Spark."""
