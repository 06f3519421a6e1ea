"""Plans made of operators: index build, search, response."""
