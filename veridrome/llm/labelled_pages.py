"""The small labelled table of page blocks.

Fixed values, written for this library: blocks that stand around an article, by
where they stand, and blocks of articles, in several languages.  Example pages are
put together from them by a rule.  All words, captions and densities that the
operator uses are estimated from these blocks.
"""

from __future__ import annotations

#: Blocks around an article, by where they stand: above, among and below it.
ABOVE = (
    "Home | News | Archive | Contact", "Forms / Registers / Help / Sitemap", "Library   Careers   Events   Press room [Harbourtown]", "Skip to main content » News · Guidance · Help",
    "Jump to navigation ↓ Home / Archive / Events / Search", "Guidance > Decisions > Enforcement", "STATISTICS · PUBLICATIONS · ABOUT US · CONTACT", "News | Contact",
    "We use cookies to measure traffic. Accept all / Settings", "This site stores small files to remember your settings. Allow | Not now", "Our pages rely on cookies to count visits. Reject optional  OK",
    "WE AND OUR PARTNERS PLACE COOKIES TO IMPROVE SEARCH. MANAGE CHOICES | CLOSE", "Cookies help us to keep forms working. Read our cookie policy | Learn more - Example Gazette",
    "By staying here you agree to cookies so that pages load faster. Save preferences / Decide later", "By the legal unit | 12 min read", "Posted by press team staff, 14 comments", "Data team correspondent, Harbourtown",
    "Author: Harbourtown research unit", "Written for Example Gazette by the audit crew", "Editor on duty: records team Harbourtown · Reading time 9 minutes", "Tags: data sharing, retention, audits", "Filed under: health, schools, access log",
    "Page updated 4 March 2024 | risk office | Harbourtown | Forms | Events", "Published by Example Authority · ISSN pending · Impressum", "Home > Decisions > Data > Example Gazette",
)
AMONG = (
    "Share this page with a colleague - 31 shares", "Share this page with a colleague - 8 shares · Harbourtown", "Print | Save | Send to a friend | 12 replies", "Copy link · Mail it · Post it", "Follow our updates and pass them on",
    "Found this useful? Tell others in your network (9)", "Like it? 4 readers did", "Listen to this text (6 min)", "Sign up for privacy alerts from the press team - enter your e-mail below", "Subscribe for audit alerts from the legal unit - enter your e-mail here",
    "Register for retention alerts from the support line - enter your e-mail below", "Join 300 schools who read our weekly letter", "Our free course on data maps starts soon - reserve a seat", "Advertisement: visit the open day in Harbourtown", "Sponsored notice: visit the open day in Harbourtown", "Announcement: visit the open day in Harbourtown",
    "Related: How banks should store the new register", "See also: Decision 12 on camera images and the sampling plan", "You may also like: Broad data map for clinics handling letters", "Most read: Letters: new register opened in Harbourtown",
)
BELOW = (
    "> Decision 40 on school records and the intake form", "* How clinics should test the yearly plan", "> Late data map for shops handling letters", "* Letters: short register closed in Harbourtown", "See also: How shops should answer a request", "Related: Decision 7 on letters and the consent banner",
    "Previous: Decision 3 on maps and the register << Next: How banks should share the plan", "Older: Yearly plan for clinics handling maps ← Newer: Letters: plan renewed in Harbourtown", "Earlier: Decision 5 on plans | Next: Broad plan for shops handling maps",
    "Categories: letters, maps, plan", "Topics: letters, maps, plan", "Was this page helpful? Yes / No", "Was this page helpful? Yes / No · Harbourtown", "Cite this page as: Harbourtown notices, no. 8", "© 2024 Example Gazette, Harbourtown · News · Help · Version 2.10", "© 2023 Example Monitor, Harbourtown · Events · Version 11.4",
    "All rights reserved Harbourtown Contact Back to top", "Terms of use - Privacy - Forms - build 12", "Home | Events | Accessibility | Imprint | Harbourtown", "Nothing on this page is legal advice. Example Gazette accepts no liability for decisions taken on its basis.", "The binding text is the one kept by Example Authority; this page is provided for information.",
    "Figures are provisional until the Example Authority has confirmed them.", "Opinions in comments are those of their authors and are removed on request.", "Translations are made for convenience; the Harbourtown edition prevails.", "Reuse is allowed if Example Gazette is named as the origin and the text is left unchanged.",
    "Download as PDF (20 kB), legal unit edition", "Last modified 9 May 2024 | press team | Harbourtown | Forms", "Printed 2 June 2024 | legal unit | Harbourtown | News | Help", "Office hours Harbourtown: weekdays nine to four", "OFFICE HOURS OF EXAMPLE GAZETTE HARBOURTOWN: MON TO THU NINE TO NOON", "Reading room Harbourtown: Tue and Fri nine to three", "Helpline of Example Gazette Harbourtown: weekdays nine to noon", "Home   News   Forms   Careers   About us", "Example Gazette - News - Archive",
)
#: Blocks of an article: headlines, running text, lists, tables, and text that speaks about page furniture.
ARTICLE = (
    "Decision 18 on letters and the sampling plan", "How banks should review the yearly register", "Broad data map for clinics handling camera images", "Letters: new plan published in Harbourtown", "Scope of the yearly plan on letters", "Next steps of the narrow register", "Effects of the broad data map", "Findings of the late audit on camera images", "Background of the short plan", "Dates of the formal register",
    "The authority found nine gaps in the register of one group of banks. Each plan names one owner and the date it was last tested.", "Costs rose by four percent after the register was renewed within ten working days.", "Records of letters are kept partly, then moved to the archive in Harbourtown. Under section 4.2, the broad plan covers maps but not letters.", "Please review the register and tell the support line which plan it replaces.",
    "A summary of the formal plan went to all clinics in March.", "If the register cannot be tested, banks have to verify letters by hand. It remains open whether shops need a yearly plan.", "• publish the yearly plan before the next review", "- register the new data map within ten working days", "(a) share the broad register ahead of the annual report", "1. print the narrow plan at the start of each month", "• follow the formal register until further notice", "- document the consent banner over the past two quarters", "(a) archive the privacy notice without undue delay", "1. download the audit trail once the appeal period ends", "- subscribe the late data map during the spring inspection",
    "data map | 12 | yearly | Harbourtown", "register | 0 | broad | Harbourtown", "privacy notice | 71 | formal | Port Example", "consent banner | 7 | narrow | Harbourtown", "The footer of a page is no substitute for a formal plan.", "Cookie notices must name each partner, and the banner may not hide the reject button from clinics.", "Subscribers who registered for letters alerts must be told when the plan is renewed.", "Share buttons count as third-party tools when shops embed them next to letters.",
    "Visitors saw the words \"service unavailable\" while the register was renewed.", "Related parties were told when the plan was printed. Most readers agreed.", "By the end of the quarter, the audit crew will share the register with all authors.", "The privacy annex treats cookie consent as sensitive whenever a page is archived.", "Terms of the contract were published in the library of Harbourtown.", "Previous plans stay in force.", "Guidance on newsletters now says that shops should send every alert within ten working days.",
    "Fees are $500 per register [see annex 2] and the set {1, 2} of options is closed.", "THE AUTHORITY FOUND NINE GAPS IN THE REGISTER OF ONE GROUP OF BANKS.", "the pilot in harbourtown showed that letters can be shared without a plan.", "404 - page not found", "You need to enable scripts to read this page.", "Content coming soon", "Sorry, something went wrong. Retry?", "placeholder copy goes here", "Your browser does not support scripting; content hidden.", "Down for maintenance. Pages return tonight.",
)


#: Blocks of sites of other kinds and languages.
MORE_ABOVE = (
    "Sign in | Register | Basket (0)", "Menu Search Close", "Shop · Brands · Sale · Stores", "Products / Pricing / Support / Docs / Login", "Startseite | Aktuelles | Themen | Presse | Kontakt", "Accueil > Actualités > Dossiers", "Inicio / Noticias / Temas / Contacto",
    "Skip navigation", "Zum Inhalt springen", "Aller au contenu", "Your privacy matters. We and 120 vendors store data on your device. Agree | More options", "Diese Website verwendet Cookies. Alle akzeptieren | Ablehnen", "Ce site utilise des cookies. Tout accepter / Refuser", "Este sitio usa cookies. Aceptar | Rechazar",
    "By Jane Doe, 3 May 2023", "Von unserer Redaktion, 3. Mai 2023", "Par la rédaction, le 3 mai 2023", "Posted on 3 May 2023 in News by admin", "Last updated 2 hours ago", "Reading time: 4 minutes", "5 min read · 12 comments", "Breadcrumb: Home » Blog » 2023",
)
MORE_AMONG = (
    "Share on social media", "Tweet | Share | Email | Print", "Click here to subscribe to our newsletter", "Sign up for our newsletter and never miss a story", "Jetzt Newsletter abonnieren", "Abonnez-vous à notre lettre d'information", "Suscríbase a nuestro boletín", "Artikel teilen", "Partager cet article", "Compartir este artículo",
    "Advertisement", "Anzeige", "Publicité", "Sponsored: great offers for you", "Read also: five tips for the garden", "Read more about this topic", "Lesen Sie auch: Fünf Tipps für den Garten", "À lire aussi : cinq conseils", "Lea también: cinco consejos", "Watch the video", "Follow us on all channels", "Download our app", "Leave a comment", "Log in to comment",
)
MORE_BELOW = (
    "Related articles", "More from this section", "Popular posts", "Trending now", "Tags: garden, tips, spring", "Schlagwörter: Garten, Tipps", "Copyright 2022 Example Ltd. All rights reserved.", "Alle Rechte vorbehalten. Impressum | Datenschutz", "Tous droits réservés. Mentions légales | Contact", "Todos los derechos reservados. Aviso legal | Contacto",
    "Privacy policy | Terms and conditions | Sitemap", "About | Contact | Careers | Press", "Previous post | Next post", "Older entries « » Newer entries", "Back to top ↑", "Nach oben", "Haut de page", "Contact us: Monday to Friday, 9am to 5pm", "Powered by Example CMS v4.2", "The views expressed are those of the author and do not reflect those of the publisher.", "The information on this site is provided without warranty.", "Was this article helpful? Yes No",
)
MORE_ARTICLE = (
    "The river rose two metres overnight and flooded the lower part of the town.", "Residents were told to leave their homes on Tuesday evening, and most of them did so without help.", "He said that the bridge had been inspected only a month before.", "What happened", "A long night", "1. Boil the water and add the salt.", "- three eggs", "• 200 g of flour", "The committee will meet again in June to decide on the budget for the next year.", "She reads the newsletter of the club every month, and shares it with her neighbours.",
    "Die Gemeinde hat den Plan im März erneuert und alle Schulen unterrichtet.", "Der Bericht nennt drei Gründe, aus denen die Frist nicht eingehalten wurde.", "La commune a renouvelé son plan en mars, mais le registre manque encore.", "Les habitants demandent que le pont soit contrôlé chaque année.", "El municipio renovó el plan en marzo y avisó a todas las escuelas.", "Los vecinos piden que se revise el puente cada año.", "City | 2021 | 2022", "Harbourtown | 14 | 17", "The law on cookies was passed in 2021 and applies to every website.", "Whoever comments must sign in first, the court held, because the operator is liable otherwise.", "Mix well, then bake for forty minutes.", "Background", "Next steps", "Results of the survey",
)

#: Notices in whole sentences, and sentences of articles that are as short.
NOTICES = (
    "Opinions in comments are those of their authors and are removed on request.", "Comments are those of readers and may be removed.", "Opinions in letters are those of their writers.", "Readers' comments are not checked before they appear.", "Figures are provisional until the office has confirmed them.", "All figures are provisional and may be changed.", "Data are provisional until confirmed by the Example Authority.", "Prices are subject to change until confirmed.",
    "Translations are made for convenience; the German edition prevails.", "This translation is provided for convenience only; the original edition prevails.", "In case of doubt the printed edition prevails.", "Reuse is allowed if the origin is named.", "Reuse of this text is allowed with the name of the site.", "Reprints are allowed on request.", "Nothing here is legal advice.", "This page is no legal advice and Example Monitor accepts no liability for it.", "No liability is accepted for the content of linked pages.", "The binding text is the printed one.", "This page is provided for information; the binding text is kept by the office.", "The official text is the one published in the gazette.",
    "Follow our updates", "Follow us and pass it on", "Join 20 readers of our weekly letter", "Join the shops who read our letter every week", "Continue reading ...", "Continue reading", "Read the full text", "Full text ...", "Open article", "Read more", "Our course on web design starts soon - book a seat", "A free course for schools starts soon - reserve a seat now", "Cite this text as: Example notices, no. 4", "Written for the Example Post by the sports desk", "Written for Example Data Watch by the news team", "Written by our reporters for the Example Ledger", "By the sports desk for the Example Post", "Figures in this notice are provisional until the inspectorate has confirmed them.", "These figures are provisional until the licensing desk has confirmed them.", "Numbers on this page are provisional until the commission has confirmed them.", "Filed under: letters, maps", "Tags: letters, maps, yearly plan", "* How shops should test the late plan", "> Decision 4 on letters and the late plan", "Our partners use cookies. Manage choices | Decide later",
)
SENTENCES = (
    "Several clinics said the register was reviewed because the earlier version named the wrong owner.", "No plan may be published unless the audit crew has tested the register first.", "Staff at the support line promptly test the register and note the reason in the data map.", "It remains open whether banks in Harbourtown need a late register for letters.", "Banks that handle letters must test their register and keep the late version for nine months.", "The audit crew will test the register again until further notice, whatever the authority decides.", "Banks and clinics disagree about the register, so the authority will test it next year.",
    "After the register was tested, complaints about letters fell from 90 to 4.", "For letters, the late threshold stays at 0.5 and the register is tested next year.", "When a request about letters arrives, the audit crew opens a register and assigns case 12.", "Members of the audit crew met in Harbourtown to test the late register on letters.", "The register and the data map were tested together since the sample was too small.", "The authority asked clinics to test the late register before the next review.", "Only 4 of the banks had a late register that the audit crew could test.", "The audit crew rarely checks the register for letters, and 12 of 90 samples were tested.", "In March, the authority found 12 gaps in the register of one group of banks.",
    "The annex treats letters as sensitive whenever a register is tested.", "The mapping lists 12 controls for letters, of which 4 were tested.", "A decision of the authority on letters will be tested in March since no register had been agreed.", "A late register was tested because staff could not find the old rules.", "Effects of the late register on letters", "Findings of the late register", "Next steps of the yearly plan on letters", "Background of the register on letters", "Dates of the late plan", "The team found placeholder text in 5 notices and had each form tested.", "Figures for March were confirmed by the audit crew.", "The court held that the translation prevails over the edition of the office.", "Comments of residents were answered within nine days.", "Two of the 12 findings concern the register; the rest relate to letters.", "pump | 45 | broken | Harbourtown", "valve | 3 | spare | Port Example", "yearly plan | 12 | late | Harbourtown", "consent form | 9 | cross-border | Port Example",
)


def _page(k: int, parts: tuple) -> list[tuple[str, bool]]:
    """The ``k``-th example page of four lists (above, among, below, article)."""
    above, among, below, article = parts
    take = lambda items, n, step: [items[(k * step + j) % len(items)] for j in range(n)]
    page = [(t, True) for t in take(above, k % 4, 3)]
    for j, t in enumerate(take(article, 1 + k % 6, 1)):
        page.append((t, False))
        if j % 3 == 1:
            page += [(t, True) for t in take(among, 1 + (k + j) % 2, j + 1)]
    page += [(t, True) for t in take(below, (k + 1) % 5, 4)]
    # upper case and wide spaces, as pages write them
    return [(t.upper() if (k + i) % 11 == 3 else t.lower() if (k + i) % 11 == 7 else f"  {t} " if k % 5 == 2 else t, a) for i, (t, a) in enumerate(page)]


def pages() -> list[list[tuple[str, bool]]]:
    """Example pages put together from the lists: (block, stands around the article)."""
    more = (MORE_ABOVE, MORE_AMONG, MORE_BELOW, MORE_ARTICLE)
    own = (ABOVE, (*AMONG, *NOTICES[20:]), (*BELOW, *NOTICES), (*ARTICLE, *SENTENCES))
    return [_page(k, own) for k in range(2 * len(own[3]))] + [_page(k, more) for k in range(2 * len(MORE_ARTICLE))]
