"""Column functions: text, rater answers, dates and the Student t distribution."""
