"""Operators: joins, matching, grouping, ranking, graphs, reviews, media and geometry."""
