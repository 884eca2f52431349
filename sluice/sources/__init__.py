"""Reading delimited text: dialect, header, rows with a ragged-row flag, standard input."""
