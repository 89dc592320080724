"""A small table of labelled passages that the abuse models start from.

Written for this library; fixed values.  It matters where few documents are
rated: it gives the models common words of abuse, and of texts that report on,
list or forbid abuse or use such words in a harmless sense.
"""

ABUSIVE = (
    "you are a stupid idiot", "you stupid moron", "you are a worthless piece of trash", "you are disgusting and everyone knows it", "what kind of idiot are you", "shut up you filthy pig", "shut your mouth, loser", "get lost, you pathetic loser", "you are too dumb to read", "what a brainless clown",
    "kill yourself", "go kill yourself, nobody would miss you", "drop dead", "I hope you die", "I hope you burn", "I will find you and kill you", "I will come to your house and beat you", "I will break your legs", "you will leave in a coffin", "watch your back or you will bleed",
    "they are vermin and should be thrown out", "these people are subhuman", "they breed like rats", "we do not want that filth here, burn their houses", "send them all back in a cage", "women belong in the kitchen", "cripples should be put down", "old people are a waste", "they are all thieves, it is in their blood", "never trust one of them",
    "send me nude pics", "send me your naked pictures, slut", "I am so horny, touch yourself for me", "strip for me while I watch", "he groped her and she moaned", "she screamed with pleasure as he undressed her", "hot girls naked on camera, full porn video", "selling dirty sex clips, message me", "you are a bastard and a whore", "suck it, bitch",
    "you make me sick", "your ugly face makes me throw up", "crawl back into the hole you came from", "your mother should have dropped you", "choke on it, scumbag", "listen, jackass, nobody likes you", "tell that moron to stay away or I will hurt him", "she is a lying cow and deserves a slap", "I spat in your food because you are a jerk", "the whole lot are imbeciles and parasites",
    "du bist ein Idiot", "halt die Fresse, du Schwein", "verschwinde, du wertloser Dreck", "die sind Ungeziefer und gehören weggejagt", "ich bring dich um", "tu es une ordure", "ferme ta gueule, crétin", "espèce d'imbécile inutile", "ces gens sont de la vermine, qu'on les chasse", "je vais te tuer", "eres un imbécil", "cállate, basura", "ojalá te mueras", "son alimañas y hay que echarlos", "te voy a matar",
)
ORDINARY = (
    "The guide lists words such as \"idiot\" and \"bastard\" so that staff can flag them.", "A slide explains why calling a colleague a moron breaches the rules.", "The form has a category for insults, threats, slurs and nude images.", "Hateful posts about residents fell after the rules were changed.", "Explicit material was removed and the case was closed.", "The word \"slut\" is on the list of terms that the filter blocks.", "He was fined because he had called a driver an idiot.", "Staff may not use abusive, hateful or sexual language.", "Threats to kill must be reported to the police.", "The report quotes an insult, \"you pig\", as evidence.",
    "Breast screening and sexual health leaflets are kept in the clinic.", "The naked eye cannot see the small print.", "The team killed the hung process and the job died twice.", "The chicken breast recipe and the cock of the weather vane.", "Members of the community asked the office to inspect the form.", "The pig farm reported rats and other vermin in the store.", "Old people and women were asked about the service.", "The dog is a bitch of two years.", "The parasite lives in warm water.", "The trash is collected on Monday.",
    "Das Wort Idiot steht auf der Liste.", "Beleidigungen und Drohungen werden gelöscht.", "Les insultes et les menaces sont supprimées.", "Le mot ordure figure sur la liste.", "Los insultos y las amenazas se eliminan.", "La palabra basura figura en la lista.",
)
