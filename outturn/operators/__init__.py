"""Operators: every public function takes DataFrames (plus parameters) and returns DataFrames."""
