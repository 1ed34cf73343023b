"""Field-survey reporting on Spark: nested submissions in, cross-tab reports out."""
