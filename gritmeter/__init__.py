"""Spark-native friction analysis of source-code repositories.

``scan`` -> ``analyze`` -> ``score`` -> ``recommend`` are lazy DataFrame
builders keyed by ``repo_id``; see :mod:`gritmeter.api`.
"""
