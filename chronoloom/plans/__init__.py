"""Plan-level helpers: session settings and materialisation points."""
