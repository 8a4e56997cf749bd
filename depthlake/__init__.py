"""depthlake: DataFrame operators for depth-indexed interval, series and label tables."""
