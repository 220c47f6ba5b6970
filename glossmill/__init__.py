"""glossmill: Spark jobs for pose-sequence data sets, prediction reports and caption quality."""
