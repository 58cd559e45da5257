from . import files, judging, registry, review, rounds, skills  # each but registry adds its queries to the registry
