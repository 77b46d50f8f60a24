"""Relational operators over detections, extractions and annotations: DataFrame in, DataFrame out."""
