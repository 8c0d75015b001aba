"""Score a labelled text corpus with several classifiers and measure them, on Spark."""
