"""Relational operators; every public function is ``DataFrame -> DataFrame``."""
