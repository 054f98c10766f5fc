"""From query text to DataFrames: lexer, parser, checks and compiler."""
