"""Security-alert processing as Spark jobs.

``sources``    raw transport messages -> alerts and rejects
``functions``  column expressions over JSON payloads, ARNs and identities
``operators``  DataFrame -> DataFrame steps (routing, history, resources, delivery, metrics)
``plans``      runbooks and the whole normalise -> route -> enrich -> deliver plan
``streaming``  the same steps under Structured Streaming
"""
